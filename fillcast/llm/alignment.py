"""Alignment of two tokenizers over a corpus, with inverted pair bitmaps.

Both tokenizers cut the same bytes. Offsets where both end a token cut the tokens into groups; the stretch between
two neighbouring offsets of either one lies in one token of each, which is a link. Documents are numbered within
blocks, and each linked pair of ids has the documents of a block as a compressed bitmap: a list of numbers, or a bit
a document where that is shorter. How often a document holds the pair is kept in planes: bit k of (times - 1) is in
plane k. Bitmaps of a block are merged by OR and popcounted in their task, so only small rows with counts are summed
over the corpus; the pair's count and whether it is the highest of its first id then return to the blocks along the
postings, where bitmaps and planes add them up for each document.
"""

from __future__ import annotations

import base64
import hashlib
import json

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillcast.operators.ordered import stored

#: Bounds of a block: documents (their numbers have 16 bits) and bytes of text.
BLOCK_DOCS, BLOCK_BYTES = 1 << 16, 16_000_000
#: Bytes of text tokenized at once.
BATCH_BYTES = 2_000_000

#: How byte-level BPE cuts a text into words.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# -- the two tokenizers -----------------------------------------------------------

def byte_level_alphabet() -> dict[str, int]:
    """The characters that stand for bytes: printable ones for themselves, the others counted on from 256."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_level_vocabulary(file: str) -> list[bytes]:
    """The bytes of each id of a byte-level BPE file.

    Merges must be in the order of their ids and nothing else may act on the text; then ids are merge ranks, and
    an encoder that goes by ranks cuts like the file's own.
    """
    spec = json.loads(file)
    model, before = spec["model"], spec["pre_tokenizer"]
    alphabet = byte_level_alphabet()
    special = {t["content"] for t in spec["added_tokens"] if t["special"]}
    ids = {t: i for t, i in model["vocab"].items() if t not in special}
    merged = [ids["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if (spec["normalizer"] is not None or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]
            or merged != sorted(merged) or sorted(ids.values()) != list(range(len(ids)))):
        raise ValueError("not a plain byte-level BPE file")
    out = [b""] * len(ids)
    for token, i in ids.items():
        out[i] = bytes(alphabet[c] for c in token)
    return out


def byte_level_encoder(entries: list[bytes]) -> tiktoken.Encoding:
    return tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks={b: i for i, b in enumerate(entries)}, special_tokens={})


def piece_bytes(pieces: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes of each id: the piece with U+2581 as space, or the byte that a byte piece stands for."""
    out = []
    for i in range(pieces.get_piece_size()):
        piece = pieces.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode())
    return out


class Aligner:
    """Both tokenizers of a task, and what is looked up by id."""

    def __init__(self, byte_entries: list[bytes], piece_model: bytes):
        self.left = byte_level_encoder(byte_entries)
        self.right = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        self.entries = (byte_entries, piece_bytes(self.right))
        self.lengths = tuple(np.fromiter(map(len, e), np.int64, len(e)) for e in self.entries)
        # An id as text, with what may follow it: a comma, or the end of its side of a group.
        self.texts = [f"{i}{after}" for e, end in zip(self.entries, "|;", strict=True) for after in (",", end) for i in range(len(e))]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; none for a text whose bytes either side doesn't give back."""
        spaced = [" " + t for t in texts]
        a = self.left.encode_ordinary_batch(spaced, num_threads=1)
        b = self.right.encode(texts, num_threads=1)
        for k, t in enumerate(spaced):
            if texts[k]:
                want = t.encode()
                if all(b"".join(map(e.__getitem__, ids)) == want for e, ids in zip(self.entries, (a[k], b[k]), strict=True)):
                    continue
            a[k], b[k] = [], []
        return a, b

    def align(self, texts: list[str | None]) -> tuple[dict[str, list], np.ndarray, np.ndarray, np.ndarray]:
        """Figures of each text, and of all links: the text's place, the left and the right id."""
        held = [k for k, t in enumerate(texts) if t]
        a, b = self.encode([texts[k] for k in held])
        n = len(texts)
        n_a, n_b = np.zeros(n, np.int64), np.zeros(n, np.int64)
        n_a[held], n_b[held] = list(map(len, a)), list(map(len, b))
        ids_a, ids_b = (np.fromiter((i for x in side for i in x), np.int64, int(c.sum())) for side, c in ((a, n_a), (b, n_b)))
        # Byte offsets run on from text to text: both sides end together at the end of each.
        ends_a, ends_b = np.cumsum(self.lengths[0][ids_a]), np.cumsum(self.lengths[1][ids_b])
        all_ends = np.union1d(ends_a, ends_b)
        link_a, link_b = np.searchsorted(ends_a, all_ends), np.searchsorted(ends_b, all_ends)
        doc_of_a = np.repeat(np.arange(n), n_a)
        link_doc = doc_of_a[link_a]
        shared_a = np.isin(ends_a, ends_b, assume_unique=True)
        shared_b = np.isin(ends_b, ends_a, assume_unique=True)
        n_groups = np.bincount(doc_of_a[shared_a], minlength=n)
        figures = {
            "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": np.bincount(link_doc, minlength=n),
            "groups_sha256": self._group_hashes(ids_a, ids_b, shared_a, shared_b, n_a, n_b)}
        return figures, link_doc, ids_a[link_a], ids_b[link_b]

    def _group_hashes(self, ids_a, ids_b, last_a, last_b, n_a, n_b) -> list[str]:
        """SHA-256 of `a1,a2|b1;a3|b2,b3` for each text, empty without tokens."""
        # A token stands after the tokens of its own side before it and those of the other side's earlier groups.
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        upto_a, upto_b = np.cumsum(np.bincount(group_a, minlength=1)), np.cumsum(np.bincount(group_b, minlength=1))
        sized_a, sized_b = len(self.entries[0]), len(self.entries[1])
        code = np.empty(len(ids_a) + len(ids_b), np.int64)
        if len(ids_a):
            code[np.arange(len(ids_a)) + np.concatenate([[0], upto_b])[group_a]] = ids_a + sized_a * last_a
            code[np.arange(len(ids_b)) + upto_a[group_b]] = 2 * sized_a + ids_b + sized_b * last_b
        look, out, at = self.texts.__getitem__, [], 0
        for size in (n_a + n_b).tolist():
            out.append(hashlib.sha256("".join(map(look, code[at:at + size].tolist()))[:-1].encode()).hexdigest() if size else "")
            at += size
        return out


# -- bitmaps of the documents of a block ------------------------------------------

LIST, BITS = 0, 1


def pack_sets(owner: np.ndarray, member: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Compressed bitmaps of the members of each owner; both arrays are sorted by (owner, member).

    Gives the owners, their popcounts, the kinds and the bytes: two a member, or a bit a document where that is shorter.
    """
    owners, start, count = np.unique(owner, return_index=True, return_counts=True)
    width = -(-docs // 8)
    kind = np.where(2 * count > width, BITS, LIST).astype(np.int8)
    dense = np.flatnonzero(kind == BITS)
    sizes = np.where(kind == BITS, width, 2 * count)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = np.zeros(int(offsets[-1]), np.uint8)
    sparse_rows = np.repeat(kind == LIST, count)
    lists = member[sparse_rows].astype("<u2").view(np.uint8)
    data[np.repeat(kind == LIST, sizes)] = lists
    for k in dense.tolist():
        bits = np.zeros(width * 8, bool)
        bits[member[start[k]:start[k] + count[k]]] = True
        data[offsets[k]:offsets[k + 1]] = np.packbits(bits, bitorder="little")
    binary = pa.Array.from_buffers(pa.binary(), len(owners), [None, pa.py_buffer(offsets.astype("<i4")), pa.py_buffer(data)])
    return owners, count, kind, binary


def unpack_sets(kind: np.ndarray, bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, member) of all members of compressed bitmaps."""
    rows, members = [], []
    sparse = np.flatnonzero(kind == LIST)
    if len(sparse):
        taken = bodies.take(pa.array(sparse))
        sizes = np.fromiter((len(x) for x in taken.to_pylist()), np.int64, len(sparse)) // 2
        joined = np.frombuffer(b"".join(taken.to_pylist()), "<u2")
        rows.append(np.repeat(sparse, sizes))
        members.append(joined.astype(np.int64))
    for k in np.flatnonzero(kind == BITS).tolist():
        found = np.flatnonzero(np.unpackbits(np.frombuffer(bodies[k].as_py(), np.uint8), bitorder="little"))
        rows.append(np.full(len(found), k))
        members.append(found)
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(members)


POSTING_FIELDS = [
    ("block", pa.int64()), ("pair", pa.int64()), ("plane", pa.int8()), ("kind", pa.int8()), ("n", pa.int32()), ("docs", pa.binary())]


def block_postings(block: int, key: np.ndarray, times: np.ndarray, docs: int) -> pa.Table:
    """The bitmaps of a block: plane -1 holds a pair's documents, plane k those with bit k set in (times - 1).

    `key` is pair * BLOCK_DOCS + document, distinct and sorted.
    """
    parts, extra = [], times - 1
    for plane in range(-1, int(extra.max(initial=0)).bit_length()):
        chosen = (extra >> plane) & 1 == 1 if plane >= 0 else np.ones(len(key), bool)
        if chosen.any():
            owners, count, kind, body = pack_sets(key[chosen] >> 16, key[chosen] & 0xFFFF, docs)
            parts.append(pa.table({
                "block": np.full(len(owners), block), "pair": owners, "plane": np.full(len(owners), plane, np.int8),
                "kind": kind, "n": count.astype(np.int32), "docs": body}))
    return pa.concat_tables(parts) if parts else pa.schema(POSTING_FIELDS).empty_table()


# -- the operator -------------------------------------------------------------------

FIGURES = ["n_a", "n_b", "n_groups", "n_links"]
ROW_SCHEMA = (
    "block bigint, pair bigint, plane tinyint, kind tinyint, n int, docs binary, "
    "place int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string")


def align_documents(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One stored table of documents (plane NULL) and postings, both by block; see the module text.

    Each text is tokenized once. A block holds the documents a task reads, up to BLOCK_DOCS of them or BLOCK_BYTES;
    the table is written before anything is made of it, so blocks and numbers stay as they are when tasks run again.
    """
    with open(byte_file, encoding="utf-8") as f:
        entries = byte_level_vocabulary(f.read())
    with open(piece_file, "rb") as f:
        model = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((entries, model))  # two vocabulary files
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        aligner = Aligner(*shared.value)
        number, ids, figures, keys, times, size = 0, [], [], [], [], 0

        def flush():
            nonlocal number, ids, figures, keys, times, size
            block = (TaskContext.get().partitionId() << 24) + number
            if keys:
                key, at = np.unique(np.concatenate(keys), return_inverse=True)
                postings = block_postings(block, key, np.bincount(at, weights=np.concatenate(times)).astype(np.int64), len(ids))
                yield from _rows(postings).to_batches(max_chunksize=20_000)
            rows = {"block": np.full(len(ids), block), "place": np.arange(len(ids), dtype=np.int32), "doc_id": pa.array(ids, pa.int64())}
            rows |= {c: np.concatenate([f[c] for f in figures]) for c in FIGURES}
            rows["groups_sha256"] = [h for f in figures for h in f["groups_sha256"]]
            yield from _rows(pa.table(rows)).to_batches(max_chunksize=20_000)
            number, ids, figures, keys, times, size = number + 1, [], [], [], [], 0

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                to, held = at, 0
                while to < len(texts) and len(ids) + to - at < BLOCK_DOCS and (held < BATCH_BYTES or to == at):
                    held += len(texts[to] or "")
                    to += 1
                found, doc, a, b = aligner.align(texts[at:to])
                key, often = np.unique((((a << 23) + b) << 16) + doc + len(ids), return_counts=True)
                keys.append(key)
                times.append(often)
                ids += doc_ids[at:to]
                figures.append(found)
                at, size = to, size + held
                if len(ids) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield from flush()
        if ids:
            yield from flush()

    return stored(source.mapInArrow(run, ROW_SCHEMA))


_ROW_TYPES = dict(POSTING_FIELDS) | {
    "place": pa.int32(), "doc_id": pa.int64(), **{c: pa.int64() for c in FIGURES}, "groups_sha256": pa.string()}


def _rows(table: pa.Table) -> pa.Table:
    """A table with all columns of ROW_SCHEMA, NULL where it has none."""
    return pa.table({c: table[c].cast(k) if c in table.column_names else pa.nulls(table.num_rows, k) for c, k in _ROW_TYPES.items()})


def pair_scores(postings: DataFrame) -> DataFrame:
    """Rows (pair, count, links, best): documents and links of each pair corpus-wide, and whether no pair of its first id has more.

    Popcounts of blocks are summed before the shuffle; the highest counts are a row an id, no more than the vocabulary.
    """
    counts = stored(postings.groupBy("pair").agg(
        F.sum(F.when(F.col("plane") < 0, F.col("n"))).alias("count"),
        F.sum(F.when(F.col("plane") < 0, F.col("n")).otherwise(F.expr("n * shiftleft(1L, plane)"))).alias("links")))
    first = F.shiftright("pair", 23)
    top = counts.groupBy(first.alias("first")).agg(F.max("count").alias("top"))
    return counts.withColumn("first", first).join(F.broadcast(top), "first").select(
        "pair", "count", "links", (F.col("count") == F.col("top")).alias("best"))


def _scored_block(key, postings: pa.Table, documents: pa.Table) -> pa.Table:
    """The documents of a block with what its postings bring back."""
    places = documents["place"].to_numpy()
    best, sums = np.zeros(BLOCK_DOCS, np.int64), np.zeros(BLOCK_DOCS, np.int64)
    for batch in postings.to_batches(max_chunksize=100_000):
        rows, members = unpack_sets(batch["kind"].to_numpy(), batch["docs"])
        each = np.int64(1) << np.maximum(batch["plane"].to_numpy(), 0).astype(np.int64)
        np.add.at(sums, members, (each * batch["count"].to_numpy())[rows])
        np.add.at(best, members, (each * batch["best"].to_numpy(zero_copy_only=False))[rows])
    return documents.select(["doc_id", *FIGURES]).append_column("n_best", pa.array(best[places])).append_column(
        "count_sum", pa.array(sums[places])).append_column("groups_sha256", documents["groups_sha256"])


def cross_tokenizer_alignment(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    NULL and empty texts, and texts whose bytes a tokenizer changes, have no tokens. Each row counts as a document,
    repeated ones too. Other columns are not looked at; an empty table gives no rows. A pair in every document has
    one posting a block, so joins split it; the documents of a block with their postings are what a task holds.
    """
    rows = align_documents(docs, byte_file, piece_file, id_col, text)
    postings = rows.filter("plane IS NOT NULL").select("block", "pair", "plane", "kind", "n", "docs")
    scores = pair_scores(postings).select("pair", "count", "best")
    returned = postings.join(scores.hint("shuffle_hash"), "pair").select("block", "plane", "kind", "docs", "count", "best")
    documents = rows.filter("plane IS NULL").select(F.col("block").alias("of_block"), "place", "doc_id", *FIGURES, "groups_sha256")
    return returned.groupBy("block").cogroup(documents.groupBy("of_block")).applyInArrow(
        _scored_block, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
