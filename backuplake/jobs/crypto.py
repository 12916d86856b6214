"""Column encryption with device keys, and key rotation over the registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backuplake.operators.windows import active_key, mark_active_keys


def encrypt(rows: DataFrame, keys: DataFrame, iv: Column, data: str = "data") -> DataFrame:
    """Base64 ciphertext under the device's active key; a device without a key gets an error row.

    `rows`: device_id, data. `keys`: device_id, key_id, secret (32 bytes), created_at, is_active.
    `iv` must be 12 bytes and never repeat under one key.
    """
    current = active_key(keys).select("device_id", "key_id", "secret")
    joined = rows.join(current, "device_id", "left").withColumn("iv", iv)
    sealed = F.aes_encrypt(
        F.col(data), F.col("secret"), F.lit("GCM"), F.lit("DEFAULT"), F.col("iv"), F.col("device_id").cast("string")
    )
    return (
        joined.withColumns(
            {
                "encrypted": F.when(F.col("secret").isNotNull(), F.base64(sealed)),
                "status": F.when(F.col("secret").isNull(), "NO_KEY").otherwise("OK"),
            }
        )
        .drop("secret", data)
    )


def decrypt(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Opens `encrypted` with the key named by `key_id`, or the active key where it is null."""
    named = keys.select("device_id", "key_id", F.col("secret").alias("_named"))
    active = active_key(keys).select("device_id", F.col("secret").alias("_active"))
    joined = rows.join(named, ["device_id", "key_id"], "left").join(active, "device_id", "left")
    secret = F.when(F.col("key_id").isNotNull(), F.col("_named")).otherwise(F.col("_active"))
    opened = F.try_aes_decrypt(
        F.unbase64("encrypted"), secret, F.lit("GCM"), F.lit("DEFAULT"), F.col("device_id").cast("string")
    )
    # One column for the opened bytes, so that they are not decrypted again for the status.
    tried = joined.withColumn("_known", secret.isNotNull()).withColumn("data", opened)
    status = F.when(~F.col("_known"), "NO_KEY").when(F.col("data").isNull(), "BAD_DATA").otherwise("OK")
    return tried.withColumn("status", status).drop("_named", "_active", "_known")


def rotate_keys(registry: DataFrame, new_keys: DataFrame) -> DataFrame:
    """The registry with the new keys added; only the newest key of a device is active."""
    return mark_active_keys(registry.unionByName(new_keys))
