"""BPE encoding and decoding of whole texts.

Long unsplit pieces are encoded by tree concatenation: halves are encoded apart, then a window
around each join is encoded again and grows until its first and last tokens are the ones already
there. Both sides then agree with the window: every pair of neighbouring tokens has been seen to
stand in an encoding, which is what makes a sequence the encoding of its letters.

Very long texts are cut at white space, and pieces inside them at any letter; parts are encoded in
parallel tasks and joined per text. Null texts count as empty. Repeated rows, ids that are null or
not unique, and further columns of any name do no harm: only `doc_id` and `text` are read, and each
row gives one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backuplake.llm.tokens import encoder

#: Letters above which an unsplit piece is encoded as a tree.
PIECE = 2048
#: Characters above which a text is cut into parts for several tasks.
PART = 1 << 16


class Tree:
    """Encodes one unsplit piece; `bare` makes a BPE model with or without the end-of-word letter."""

    longest = PIECE

    def __init__(self, bare, suffix: dict):
        self.middle, self.end = bare(), bare(**suffix)
        self.texts = {i: t for t, i in self.end.get_vocab().items()}
        self.suffix = suffix.get("end_of_word_suffix", "")

    def _ids(self, letters: str, last: bool) -> list[int]:
        return (self.end if last else self.middle).encode(letters, add_special_tokens=False).ids

    def _text(self, ids: list[int]) -> str:
        text = "".join(self.texts[i] for i in ids)
        return text

    def encode(self, letters: str, last: bool = True) -> list[int]:
        parts = [letters[i : i + self.longest] for i in range(0, len(letters), self.longest)]
        row = [self._ids(p, last and i == len(parts) - 1) for i, p in enumerate(parts)]
        while len(row) > 1:
            pairs = range(0, len(row) - 1, 2)
            ends = [last and i + 2 >= len(row) for i in pairs]
            merged = [self.join(row[i], row[i + 1], end) for i, end in zip(pairs, ends)]
            row = merged + row[len(row) - len(row) % 2 :]
        return row[0] if row else []

    def join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """Encoding of two parts that stand side by side; `last`: the right one ends the piece."""
        if not left or not right:
            return left + right
        a, b = min(4, len(left)), min(4, len(right))
        while True:
            window = left[len(left) - a :] + right[:b]
            ends = last and b == len(right)
            text = self._text(window)
            if ends and self.suffix:
                text = text[: len(text) - len(self.suffix)]
            again = self._ids(text, ends)
            grow_left = a < len(left) and again[0] != window[0]
            grow_right = b < len(right) and again[-1] != window[-1]
            if not (grow_left or grow_right) and (len(again) > 1 or (a == len(left) and b == len(right))):
                return left[: len(left) - a] + again + right[b:]
            if a == len(left) and b == len(right):
                return again
            a = min(2 * a, len(left)) if grow_left or len(again) == 1 else a
            b = min(2 * b, len(right)) if grow_right or len(again) == 1 else b


def _batches(fn, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict(fn(batch), schema=schema)

    return run


def _encode_rows(texts: list[str | None], path: str) -> tuple[object, list[bytes]]:
    coder = encoder(path, Tree)
    return coder, coder.encode([t or "" for t in texts])


def _parts(docs: DataFrame, part: int) -> DataFrame:
    """Long texts cut before a space; runs without white space are left in one part."""
    cuts = F.regexp_extract_all(
        F.coalesce("text", F.lit("")), F.lit(f"(?s)(?:.{{1,{part}}}\\S*)"), F.lit(0)
    )
    return docs.select("_row", "doc_id", F.posexplode(cuts).alias("_pos", "text"))


def _apart(docs: DataFrame, fn, schema: str, arrow: pa.Schema, join, part: int, path: str) -> DataFrame:
    """Short texts row by row; long ones part by part, then joined in text order."""
    rows = docs.select("doc_id", "text")
    short = rows.filter(F.coalesce(F.length("text"), F.lit(0)) <= part)
    done = short.mapInArrow(_batches(fn, arrow), schema)
    # The id of a row of a scan is the same in every attempt.
    long = rows.withColumn("_row", F.monotonically_increasing_id()).filter(F.length("text") > part)

    def encode_part(batch: pa.RecordBatch) -> dict:
        coder, ids = _encode_rows(batch.column("text").to_pylist(), path)
        return {
            "_row": batch.column("_row"),
            "doc_id": batch.column("doc_id"),
            "_pos": batch.column("_pos"),
            "ids": [coder.ids(i).astype("<u4").tobytes() for i in ids],
        }

    id_type = rows.schema["doc_id"].dataType.simpleString()
    doc_id = arrow.field("doc_id").type
    part_schema = pa.schema([("_row", pa.int64()), ("doc_id", doc_id), ("_pos", pa.int32()), ("ids", pa.binary())])
    pieces = _parts(long, part).repartition("_row", "_pos")
    encoded = pieces.mapInArrow(_batches(encode_part, part_schema), f"_row long, doc_id {id_type}, _pos int, ids binary")

    def joined(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("_pos").to_numpy(), kind="stable")
        ids = table.column("ids").to_pylist()
        data = b"".join(ids[i] for i in order)
        return pa.Table.from_pydict(
            {k: [v] for k, v in join(table.column("doc_id")[0].as_py(), np.frombuffer(data, "<u4")).items()}, schema=arrow
        )

    return done.unionByName(encoded.groupBy("_row").applyInArrow(joined, schema))


def encode(docs: DataFrame, path: str, part: int = PART) -> DataFrame:
    """doc_id and `ids`, the array of token ids of each whole text."""

    def fn(batch: pa.RecordBatch) -> dict:
        coder, data = _encode_rows(batch.column("text").to_pylist(), path)
        return {"doc_id": batch.column("doc_id"), "ids": [coder.ids(d).astype(np.int32) for d in data]}

    kind = docs.schema["doc_id"].dataType
    arrow = pa.schema([("doc_id", _arrow(kind)), ("ids", pa.list_(pa.int32()))])
    schema = f"doc_id {kind.simpleString()}, ids array<int>"
    return _apart(docs, fn, schema, arrow, lambda i, ids: {"doc_id": i, "ids": ids.astype(np.int32)}, part, path)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and `text` decoded from `ids`."""

    def fn(batch: pa.RecordBatch) -> dict:
        coder = encoder(path, Tree)
        ids = [np.array(i or [], np.int64) for i in batch.column("ids").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "text": [coder.decode(i) for i in ids]}

    kind = encoded.schema["doc_id"].dataType
    arrow = pa.schema([("doc_id", _arrow(kind)), ("text", pa.string())])
    return encoded.select("doc_id", "ids").mapInArrow(_batches(fn, arrow), f"doc_id {kind.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, part: int = PART) -> DataFrame:
    """Per document: number of tokens, digest of its ids, digest of the text decoded from them.

    What `encode` and `decode` give, digested in the task that made it, so that neither ids nor
    texts leave it.
    """

    def digests(coder, ids: np.ndarray) -> tuple[int, str, str]:
        numbers = " ".join(map(str, ids.tolist())).encode()
        text = coder.decode(ids).encode("utf-8", "surrogatepass")
        return len(ids), hashlib.sha256(numbers).hexdigest(), hashlib.sha256(text).hexdigest()

    def fn(batch: pa.RecordBatch) -> dict:
        coder, data = _encode_rows(batch.column("text").to_pylist(), path)
        rows = [digests(coder, coder.ids(d)) for d in data]
        n, ids, text = zip(*rows) if rows else ((), (), ())
        return {"doc_id": batch.column("doc_id"), "n_tokens": n, "ids_sha256": ids, "decoded_sha256": text}

    def join(doc_id, ids: np.ndarray) -> dict:
        n, numbers, text = digests(encoder(path, Tree), ids)
        return {"doc_id": doc_id, "n_tokens": n, "ids_sha256": numbers, "decoded_sha256": text}

    kind = docs.schema["doc_id"].dataType
    arrow = pa.schema(
        [("doc_id", _arrow(kind)), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    )
    schema = f"doc_id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _apart(docs, fn, schema, arrow, join, part, path)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
