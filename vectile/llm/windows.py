"""Removal of repeated word windows: a count-min prefilter, then exact groups of the windows estimated repeated.

Documents are packed into blocks of about ``BLOCK_WORDS`` words, written once as compressed rows. Three passes follow.

1. Every block counts its windows in a count-min sketch, sparsely: the cells it touches and whether it does so twice. The sketches are
   cut into slabs of cells and merged slab by slab. A block gets back which of its cells reach two in the merged sketch. Counts
   saturate at two, as nothing above is asked for, and the width follows the number of words, so the error rate does not grow.
2. A window all of whose cells reach two is estimated repeated; a sketch never underestimates, so no repeated one is lost. Of those, a
   block sends the hash of each distinct window with its first document, and groups by hash find the first block of each.
3. Every other occurrence is a repeat. Its words go.

All messages are one row per block and slab and hold sorted, packed arrays, so neither a frequent window nor a large group of
copies makes a large group: a block mentions a window once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vectile.session import materialise, ship_by_value

BLOCK_WORDS, BLOCK_BYTES = 1 << 19, 8 << 20
ROWS = 2  # of the sketch
CELLS_PER_WORD = 8
SLAB_BITS, GROUP_ENTRIES = 25, 4 << 20  # cells of a slab; entries of a group of the exact pass
SPREAD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)  # odd, one per sketch row
BASE = 0xA0761D6478BD642F  # odd
INVERSE = pow(BASE, -1, 1 << 64)
BLOCKS = "block long, n_words long, payload binary"


# -- packed arrays ---------------------------------------------------------------------------------


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending whole numbers as differences of the fewest bytes that hold them all, compressed.

    Lowest bytes come first, then the next ones of all differences, so the few large differences that need one byte more cost little.
    The first byte says how many there are, the next eight how many numbers.
    """
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + len(steps).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)


def unpack_sorted(packed: bytes) -> np.ndarray:
    width, n = packed[0], int.from_bytes(packed[1:9], "little")
    raw = pa.Codec("zstd").decompress(packed[9:], decompressed_size=width * n, asbytes=True)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return np.cumsum(wide.view("<u8").ravel())


def _among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)
    return ascending[at] == values


# -- blocks ----------------------------------------------------------------------------------------


def _packed_block(number: int, ids: list, texts: list[str], n_words: int, id_type: pa.DataType) -> pa.RecordBatch:
    rows = pa.record_batch([pa.array(ids, id_type), pa.array(texts, pa.large_string())], names=["doc_id", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as out:
        out.write_batch(rows)
    return pa.record_batch([pa.array([number]), pa.array([n_words]), pa.array([sink.getvalue().to_pybytes()])], names=["block", "n_words", "payload"])


def pack_blocks(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(block, n_words, payload): ``docs`` (doc_id, text) in rows of about ``block_words`` words, or one longer text."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, held, size = TaskContext.get().partitionId() << 32, [], [], 0, 0
        id_type = pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                ids.append(doc_id)
                texts.append(text)
                held += len(text.encode().split())
                size += len(text)
                if held >= block_words or size >= BLOCK_BYTES:
                    yield _packed_block(number, ids, texts, held, id_type)
                    number, ids, texts, held, size = number + 1, [], [], 0, 0
        if ids:
            yield _packed_block(number, ids, texts, held, id_type)

    return docs.mapInArrow(pack, BLOCKS)


class Block:
    """The words and window hashes of a block, its documents in their order: id (null last), then text, by its hash."""

    def __init__(self, payload: bytes, width: int):
        rows = pa.ipc.open_stream(payload).read_all().combine_chunks()
        texts = [t.as_py().encode() for t in rows.column("text")]
        digest = np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts))
        ids = rows.column("doc_id")
        null = ids.is_null().to_numpy()
        plain = ids.fill_null(0).to_numpy()
        order = np.lexsort((digest, plain, null))
        self.ids = ids.take(pa.array(order))
        self.key = {"null": null[order].astype(np.uint8), "id": plain[order].astype(np.int64), "digest": digest[order]}
        self.words = [texts[i].split() for i in order]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        flat = list(chain.from_iterable(self.words))
        distinct = set(flat)
        number = {w: i for i, w in enumerate(distinct)}
        codes = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        lanes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, distinct)), "<u8").reshape(-1, 2)
        # windows that end in their document
        n = np.maximum(self.sizes - width + 1, 0)
        self.at = np.repeat(self.starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
        self.doc = np.repeat(np.arange(len(n)), n)
        powers = np.full(len(flat) + 1, BASE, np.uint64)
        undo = np.full(len(flat) + 1, INVERSE, np.uint64)
        powers[:1] = undo[:1] = 1
        powers, undo = np.cumprod(powers), np.cumprod(undo)
        self.hash, check = (self._windows(lanes[codes, i], powers, undo, width) for i in (0, 1))
        self.check = (check >> np.uint64(32)).astype(np.uint32)

    def _windows(self, words: np.ndarray, powers: np.ndarray, undo: np.ndarray, width: int) -> np.ndarray:
        """A polynomial of the words' hashes, from its running sums, then mixed."""
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers[:-1])])
        x = (sums[self.at + width] - sums[self.at]) * undo[self.at]
        x ^= x >> np.uint64(32)
        x *= np.uint64(SPREAD[3])
        return x ^ (x >> np.uint64(29))

    def cells(self, row: int, bits: int) -> np.ndarray:
        return (self.hash * np.uint64(SPREAD[row])) >> np.uint64(64 - bits)

    def repeated(self, hot: list[np.ndarray], bits: int) -> np.ndarray:
        """Windows all of whose cells are among the ``hot`` ones of their sketch row."""
        kept = np.arange(len(self.at))
        for row, cells in enumerate(hot):
            kept = kept[_among(self.cells(row, bits)[kept], cells)]
        return kept

    def distinct(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first of each distinct one of ``windows``, by hash, and for every window the number of its own."""
        order = windows[np.lexsort((windows, self.check[windows], self.hash[windows]))]
        new = np.ones(len(order), bool)
        new[1:] = (self.hash[order][1:] != self.hash[order][:-1]) | (self.check[order][1:] != self.check[order][:-1])
        return order[new], order


# -- the passes ------------------------------------------------------------------------------------


def _cuts(ascending: np.ndarray, shift: int, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of the ascending numbers, a part being their bits above ``shift``."""
    edges = np.searchsorted(ascending >> np.uint64(shift) if shift < 64 else np.zeros(len(ascending), np.uint64), np.arange(parts + 1, dtype=np.uint64))
    return ((p, a, b) for p, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if a < b)


def hot_cells(blocks: DataFrame, width: int, bits: int, rows: int = ROWS, slab_bits: int = SLAB_BITS) -> DataFrame:
    """(block, slab, n, payload): the cells of each block that reach two in the merged sketch of all blocks."""
    slab_bits = min(slab_bits, bits)
    slabs = 1 << (bits - slab_bits)
    in_slab = np.uint64((1 << slab_bits) - 1)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                block = Block(payload.as_py(), width)
                out = []
                for row in range(rows):
                    cells, counts = np.unique(block.cells(row, bits), return_counts=True)
                    marked = ((cells & in_slab) << np.uint64(1)) | (counts > 1).astype(np.uint64)
                    out += [(row * slabs + s, number, pack_sorted(marked[a:b])) for s, a, b in _cuts(cells, slab_bits, slabs)]
                yield pa.RecordBatch.from_pylist([dict(zip(("slab", "block", "payload"), o)) for o in out], SKETCH)

    def merge(group: pa.Table) -> pa.Table:
        marked = [unpack_sorted(p.as_py()).astype(np.uint32 if slab_bits < 32 else np.uint64) for p in group.column("payload")]
        together = np.sort(np.concatenate(marked))
        cells = together >> 1
        twice = (together & 1).astype(bool)
        twice[1:] |= cells[1:] == cells[:-1]
        hot = np.unique(cells[twice])
        mine = [(m >> 1)[_among(m >> 1, hot)] for m in marked]
        out = [{"block": b, "slab": s, "n": len(m), "payload": pack_sorted(m)} for b, s, m in zip(group.column("block").to_pylist(), group.column("slab").to_pylist(), mine) if len(m)]
        return pa.Table.from_pylist(out, HOT)

    return blocks.mapInArrow(sketch, "slab long, block long, payload binary").groupBy("slab").applyInArrow(merge, "block long, slab long, n long, payload binary")


SKETCH = pa.schema([("slab", pa.int64()), ("block", pa.int64()), ("payload", pa.binary())])
HOT = pa.schema([("block", pa.int64()), ("slab", pa.int64()), ("n", pa.int64()), ("payload", pa.binary())])


def _hot_of(answers: pa.Table, rows: int, bits: int, slab_bits: int) -> list[np.ndarray]:
    slabs = 1 << (bits - slab_bits)
    parts: list[dict[int, np.ndarray]] = [{} for _ in range(rows)]
    for slab, payload in zip(answers.column("slab").to_pylist(), answers.column("payload")):
        parts[slab // slabs][slab % slabs] = unpack_sorted(payload.as_py()) + np.uint64((slab % slabs) << slab_bits)
    return [np.concatenate([own[s] for s in sorted(own)]) if own else np.empty(0, np.uint64) for own in parts]


ASK_FIELDS = ("hash", "check", "doc", "null", "id", "digest")
ASK = pa.schema([("group", pa.int64()), ("block", pa.int64()), *((f, pa.binary()) for f in ASK_FIELDS)])
FIRST = pa.schema([("block", pa.int64()), ("slab", pa.int64()), ("n", pa.int64()), ("payload", pa.binary())])


def first_blocks(blocks: DataFrame, hot: DataFrame, width: int, bits: int, group_bits: int, rows: int = ROWS, slab_bits: int = SLAB_BITS) -> DataFrame:
    """(block, slab, n, payload): for each group of hashes, which of the block's distinct windows have no earlier occurrence elsewhere."""
    slab_bits = min(slab_bits, bits)

    def ask(key: tuple, mine: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(mine.column("payload")[0].as_py(), width)
        entries, _ = block.distinct(block.repeated(_hot_of(answers, rows, bits, slab_bits), bits))
        out = []
        for part, a, b in _cuts(block.hash[entries], 64 - group_bits, 1 << group_bits):
            own = entries[a:b]
            docs, doc = np.unique(block.doc[own], return_inverse=True)
            arrays = (block.hash[own], block.check[own], doc.astype(np.uint32), *(block.key[k][docs] for k in ("null", "id", "digest")))
            out.append({"group": part, "block": key[0].as_py(), **{f: x.tobytes() for f, x in zip(ASK_FIELDS, arrays)}})
        return pa.Table.from_pylist(out, ASK)

    def answer(group: pa.Table) -> pa.Table:
        read = lambda f, kind: [np.frombuffer(x.as_py(), kind) for x in group.column(f)]
        hashes, checks, docs = read("hash", np.uint64), read("check", np.uint32), read("doc", np.uint32)
        null, ids, digest = read("null", np.uint8), read("id", np.int64), read("digest", np.uint64)
        numbers = group.column("block").to_pylist()
        sizes = np.array([len(x) for x in ids])
        owner = np.repeat(np.array(numbers), sizes)
        place = np.empty(len(owner), np.int64)  # of a document among all that are mentioned
        place[np.lexsort((owner, *(np.concatenate(x) for x in (digest, ids, null))))] = np.arange(len(owner))
        base = np.cumsum(sizes) - sizes
        places = np.concatenate([place[d + b] for d, b in zip(docs, base)])
        h, c = np.concatenate(hashes), np.concatenate(checks)
        order = np.lexsort((places, c, h))
        first = np.ones(len(order), bool)
        first[1:] = (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])
        found = np.empty(len(order), bool)
        found[order] = first
        cuts = np.cumsum([len(x) for x in hashes])[:-1]
        part = group.column("group")[0].as_py()
        return pa.Table.from_pylist([{"block": b, "slab": part, "n": len(f), "payload": np.packbits(f).tobytes()} for b, f in zip(numbers, np.split(found, cuts))], FIRST)

    asked = blocks.groupBy("block").cogroup(hot.groupBy("block")).applyInArrow(ask, "group long, block long, " + ", ".join(f"`{f}` binary" for f in ASK_FIELDS))
    return asked.groupBy("group").applyInArrow(answer, "block long, slab long, n long, payload binary")


def kept_words(blocks: DataFrame, hot: DataFrame, first: DataFrame, width: int, bits: int, id_type: T.DataType, rows: int = ROWS, slab_bits: int = SLAB_BITS) -> DataFrame:
    slab_bits = min(slab_bits, bits)
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def keep(key: tuple, mine: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(mine.column("payload")[0].as_py(), width)
        kind = answers.column("kind").to_numpy()
        hot_rows, first_rows = (answers.filter(pa.array(kind == k)) for k in (0, 1))
        entries, order = block.distinct(block.repeated(_hot_of(hot_rows, rows, bits, slab_bits), bits))
        again = np.zeros(len(block.at), bool)
        again[order] = True
        if len(entries):
            flags = sorted(zip(first_rows.column("slab").to_pylist(), first_rows.column("n").to_pylist(), first_rows.column("payload").to_pylist()))
            leads = np.concatenate([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for _, n, p in flags]).astype(bool)
            again[entries[leads]] = False
        covered = np.zeros(int(block.sizes.sum()) + 1, np.int64)
        np.add.at(covered, block.at[again], 1)
        np.add.at(covered, block.at[again] + width, -1)
        stays = np.cumsum(covered)[:-1] == 0
        kept, removed = [], []
        for start, words in zip(block.starts.tolist(), block.words):
            own = stays[start : start + len(words)]
            kept.append(b" ".join(words if own.all() else compress(words, own.tolist())).decode())
            removed.append(len(words) - int(own.sum()))
        columns = [block.ids.cast(arrow_id), pa.array(block.sizes), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
        return pa.Table.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept"])

    arrow_id = to_arrow_type(id_type)
    answers = hot.withColumn("kind", F.lit(0)).unionByName(first.withColumn("kind", F.lit(1)))
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(keep, schema)


def drop_repeated_windows(docs: DataFrame, width: int = 20, doc_id: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS, slab_bits: int = SLAB_BITS, group_entries: int = GROUP_ENTRIES) -> DataFrame:
    """One row per document: (doc_id, n_words, n_removed, kept), ``kept`` being the words that stay, joined by single spaces.

    A window is ``width`` consecutive words of a document. A word goes if it lies in a window whose words also start earlier: in a
    document with a smaller id, or further up in its own. Of windows that start nowhere earlier all words stay, so one copy of
    every passage stays. Rows that share an id follow a hash of their texts, and of equal rows one counts as the
    first; null ids come last. Null, empty and wordless texts, and those of fewer words than a window, lose nothing. Texts of any length
    are taken whole. An empty table gives no rows. Other columns, whatever their names, are not read. Ids are whole numbers.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    blocks = materialise(pack_blocks(rows, block_words))
    n_words = blocks.agg(F.sum("n_words")).first()[0] or 0
    bits = max(16, (CELLS_PER_WORD * n_words - 1).bit_length() if n_words else 0)
    hot = materialise(hot_cells(blocks, width, bits, slab_bits=slab_bits))
    n_hot = hot.agg(F.sum("n")).first()[0] or 0
    group_bits = max(0, (n_hot // group_entries).bit_length())
    first = materialise(first_blocks(blocks, hot, width, bits, group_bits, slab_bits=slab_bits))
    return kept_words(blocks, hot, first, width, bits, rows.schema["doc_id"].dataType, slab_bits=slab_bits)


ship_by_value(__name__)
