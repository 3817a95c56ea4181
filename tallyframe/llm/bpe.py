"""Byte-level BPE by higher-order functions over the distinct words.

Texts are split by the pattern of the rank files. The distinct words of the corpus are encoded once each: a fold over a word's
array of single-byte tokens merges, step by step, the adjacent pair of lowest rank, which it looks up in a literal rank map (from
the two token ids to the id of both). The map is an array of small maps by a hash of the pair, so a lookup is short.

A step of the fold of a word of up to ``SHORT`` bytes merges one pair. A longer word is a string of its tokens, and a step replaces
every occurrence of the pair of lowest rank, from the left; a merged pair's rank is above those of its parts, so that is the order in
which single steps would merge them. Its steps grow with the number of different merges, not with the word's length. Decoding
concatenates the byte pieces of the ids, for each distinct word once; a text's bytes are those of its words in order.

Documents meet their words in groups of consecutive rows of some megabytes. A group deals its distinct words into buckets by hash; a
bucket encodes each of its words once and sends every group its own words with their ids and bytes, and a co-group brings these to the
group's texts. No dictionary of the corpus is broadcast or held in one place: a group's and a bucket's size stay the same as the corpus
grows, and so does what a task reads. Texts are split into words, and their ids and bytes gathered, a megabyte at a time.

Defined cases: a null text counts as empty and has no ids; repeated rows are rows each; a null doc_id stays null; an empty table
gives an empty result; extra columns are ignored. Special tokens in a text are ordinary text. A text is in one group whatever its size.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import literal, parts_for, size_of, stable
from tallyframe.llm.tokens import joined_up, matches, offsets_of, pieces_of, spaced_out, split_texts

NONE = 2**31 - 1
#: Bytes of a word up to which its fold merges a pair a step: in a short word a pair seldom comes twice.
SHORT = 64
#: Words that are encoded as one row.
A_ROW = 2000
#: Bytes of texts that are split into words at a time: split words take many times the room of their text.
A_TIME = 1 << 20
#: Words that are Python objects at a time.
STEP = 5_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pair_map(ranks: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """shift, slots: the pair (left, right) becomes slots[shift[left] + right] & 0xFFFF if that slot >> 16 is left, else nothing.

    The rows of a sparse table of pairs lie over each other, each shifted to where its entries are free: longest rows first, from a
    place by hash.
    """
    rows: dict[int, dict[int, int]] = {}
    for token, rank in ranks.items():
        for at in range(1, len(token)):
            left, right = ranks.get(token[:at]), ranks.get(token[at:])
            if left is not None and right is not None:
                rows.setdefault(left, {})[right] = rank
    width = max(ranks.values()) + 1
    size = 8 * width
    slots, shift = [-1] * (size + width), [0] * width
    for left in sorted(rows, key=lambda k: (-len(rows[k]), k)):
        at = left * 2654435761 % size
        while any(slots[at + right] >= 0 for right in rows[left]):
            at = (at + 40503) % size
        shift[left] = at
        for right, rank in rows[left].items():
            slots[at + right] = left << 16 | rank
    return shift, slots


def decode_ids(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of an array of ids: their pieces, one after the other."""
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    table = literal(pieces, "string")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""))


def encode_words(words: DataFrame, ranks: dict[bytes, int], source: str = "words", out: str = "ids") -> DataFrame:
    """Add ``out`` (array<array<int>>): the ids of each of an array of words (binary)."""

    shift, slots = pair_map(ranks)
    shift, slots = literal(shift, "int"), literal(slots, "bigint")
    single = literal([ranks[bytes([b])] for b in range(256)], "int")
    digit = literal([*range(10), *[0] * 7, *range(10, 16)], "int")
    none = F.lit(NONE)

    def start(word: Column) -> Column:
        nibble = lambda at: F.get(digit, F.ascii(at) - 48)
        return F.transform(F.regexp_extract_all(F.hex(word), F.lit(".."), F.lit(0)), lambda x: F.get(single, nibble(x) * 16 + nibble(F.substring(x, 2, 1))))

    def ranked(ids: Column) -> Column:
        """The rank of each pair of neighbours."""
        found = F.zip_with(ids, F.slice(ids, 2, F.size(ids)), lambda a, b: F.get(slots, F.get(shift, a) + b))  # null for the last
        return F.zip_with(found, ids, lambda e, a: F.when(F.shiftright(e, 16) == a, e.bitwiseAND(F.lit(65535)).cast("int")).otherwise(none))

    def step(ids: Column, _: Column) -> Column:
        merged = F.transform(F.array(ranked(ids)), lambda p: F.transform(F.array(F.array_min(p)), lambda least: F.when(least == none, F.array_append(ids, F.lit(-1))).otherwise(joined(ids, p, least)))[0])
        return F.when(F.element_at(ids, -1) == -1, ids).otherwise(merged[0])  # a last -1: no pair is left

    def joined(ids: Column, p: Column, least: Column) -> Column:
        return F.transform(F.array(F.array_position(p, least).cast("int")), lambda at: F.concat(F.slice(ids, F.lit(1), at - 1), F.array(least), F.slice(ids, at + 2, F.size(ids))))[0]

    def short(word: Column) -> Column:
        return F.array_remove(F.aggregate(F.sequence(F.lit(1), F.octet_length(word)), start(word), step), -1)

    def tokens(chain: Column) -> Column:
        return F.split(F.substring(chain, F.lit(2), F.length(chain) - 2), "><").cast("array<int>")

    def every(state: Column, _: Column) -> Column:
        """Replace all that is the pair of lowest rank; a chain of tokens is <first><second>..."""

        def with_ranks(at: Column) -> Column:
            return F.transform(F.array(F.array_min(at["p"])), lambda least: F.when(least == none, ended(at["chain"])).otherwise(replaced(at, least)))[0]

        def replaced(at: Column, least: Column) -> Column:
            first = F.array_position(at["p"], least).cast("int")
            pair = F.concat(F.lit("<"), F.get(at["ids"], first - 1).cast("string"), F.lit("><"), F.get(at["ids"], first).cast("string"), F.lit(">"))
            return F.struct(F.replace(at["chain"], pair, F.concat(F.lit("<"), least.cast("string"), F.lit(">"))).alias("chain"), F.lit(False).alias("done"))

        def ended(chain: Column) -> Column:
            return F.struct(chain.alias("chain"), F.lit(True).alias("done"))

        ids = F.transform(F.array(tokens(state["chain"])), lambda ids: F.struct(state["chain"].alias("chain"), ids.alias("ids"), ranked(ids).alias("p")))
        return F.when(state["done"], state).otherwise(F.transform(ids, with_ranks)[0])

    def long(word: Column) -> Column:
        chain = F.concat(F.lit("<"), F.array_join(start(word).cast("array<string>"), "><"), F.lit(">"))
        return F.aggregate(F.sequence(F.lit(1), F.octet_length(word)), F.struct(chain.alias("chain"), F.lit(False).alias("done")), every, lambda s: tokens(s["chain"]))

    return words.withColumn(out, F.transform(source, lambda word: F.when(F.octet_length(word) <= SHORT, short(word)).otherwise(long(word))))


def _packed(*columns: pa.Array) -> bytes:
    """Columns of as many binary values, with their lengths, compressed together: what decoded words repeat of the words costs little."""
    out = [len(columns[0]).to_bytes(4, "little")]
    for column in columns:
        at = offsets_of(column)
        out += [np.diff(at).astype("<u4").tobytes(), column.buffers()[2].slice(at[0], at[-1] - at[0]) if at[-1] > at[0] else b""]
    return zstandard.compress(b"".join(out), 3)


def _unpacked(blob: bytes, columns: int) -> list[pa.Array]:
    raw = pa.py_buffer(zstandard.decompress(blob))
    n, at, out = int.from_bytes(raw[:4].to_pybytes(), "little"), 4, []
    for _ in range(columns):
        ends = np.zeros(n + 1, np.int32)
        np.cumsum(np.frombuffer(raw, "<u4", n, at), out=ends[1:])
        out.append(pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), raw.slice(at + 4 * n, int(ends[-1]))]))
        at += 4 * n + int(ends[-1])
    return out


def _hashed(words: pa.Array, buckets: int) -> np.ndarray:
    """A bucket for each word (binary, not empty), by a polynomial of its bytes."""
    out = np.zeros(len(words), np.int64)
    for k in range(0, len(words), STEP):  # the numbers are eight bytes for each of the words' and several at a time
        at = offsets_of(words.slice(k, STEP))
        raw = np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]].astype(np.uint64)
        at = at - at[0]
        place = np.arange(len(raw)) - np.repeat(at[:-1], np.diff(at))
        powers = np.cumprod(np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
        sums = np.add.reduceat((raw + np.uint64(1)) * powers[place], at[:-1])
        out[k : k + STEP] = ((sums ^ (sums >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) % np.uint64(buckets)
    return out


def _some(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Texts in order, about so many bytes at a time; one at least."""
    ends, at = np.cumsum(np.diff(offsets_of(texts)), dtype=np.int64), 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield texts.slice(at, upto - at)
        at = upto


class _Groups:
    """Numbers the groups of a task's rows: a group ends where its texts come to ``most`` bytes."""

    def __init__(self, most: int):
        from pyspark import TaskContext

        self.now, self.most, self.size = TaskContext.get().partitionId() << 32, most, 0

    def cut(self, texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
        """Runs of texts, each with its group."""
        ends, at = np.cumsum(np.diff(offsets_of(texts)), dtype=np.int64), 0
        while at < len(texts):
            if self.size >= self.most:
                self.now, self.size = self.now + 1, 0
            before = int(ends[at - 1]) if at else 0
            upto = min(len(texts), int(np.searchsorted(ends, before + self.most - self.size)) + 1)
            self.size += int(ends[upto - 1]) - before
            yield self.now, texts.slice(at, upto - at)
            at = upto


def _distinct(pattern: str, most: int, buckets: int):
    """For each group of rows: its distinct words, dealt into buckets by hash."""

    def split(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The distinct words of some texts, and their distinct heads."""
        values, _, first = pieces_of(split_texts(texts))
        return pc.unique(values.filter(pa.array(~first))), pc.unique(values.filter(pa.array(first)))

    def dealt(find: Callable[[str], list[str]], group: int, held: list[tuple[pa.Array, pa.Array]]) -> pa.RecordBatch:
        words, heads = (pc.unique(pa.concat_arrays(column)) for column in zip(*held))
        letters = pc.and_(pc.string_is_ascii(words), pc.ascii_is_alpha(words))  # these are one match each
        own, other = [spaced_out(words.filter(letters))], words.filter(pc.invert(letters))
        for k in range(0, len(heads), STEP):  # what is held as Python objects stays small
            own.append(pa.array([m.encode() for m in {m for head in heads.slice(k, STEP).to_pylist() for m in find(head)}], pa.binary()))
        for k in range(0, len(other), STEP):
            own.append(pa.array([m.encode() for m in {m for word in other.slice(k, STEP).to_pylist() for m in matches(find, word)}], pa.binary()))
        own = pc.unique(pa.concat_arrays(own))
        if not len(own):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.binary())], names=["bucket", "part", "blob"])
        table = pa.table({"bucket": _hashed(own, buckets), "word": own})
        table = table.take(pc.sort_indices(table, sort_keys=[("bucket", "ascending"), ("word", "ascending")])).combine_chunks()
        bucket, own = table.column(0).to_numpy(), table.column(1).chunk(0)
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]).tolist()
        blobs = [_packed(own.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array([group] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, groups, now, held = regex.compile(pattern).findall, _Groups(most), None, []
        for batch in batches:
            for group, texts in groups.cut(batch.column(0)):
                if group != now and held:
                    yield dealt(find, now, held)
                    held = []
                    pa.default_memory_pool().release_unused()
                now = group
                held += [split(some) for some in _some(texts, A_TIME)]
        if held:
            yield dealt(find, now, held)
        pa.default_memory_pool().release_unused()

    return run


ROW = "part long, members binary, words array<binary>"


def _bucket(tab: pa.Table) -> pa.Table:
    """A bucket's distinct words, some thousand a row, and then for each group the numbers of its words."""
    blobs = [_unpacked(blob.as_py(), 1)[0] for blob in tab.column("blob")]
    known = pa.concat_arrays(blobs).dictionary_encode()
    words, number = known.dictionary, known.indices.to_numpy().astype("<u4")
    ends = np.cumsum([0, *map(len, blobs)]).tolist()
    members = [number[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
    cuts = [*range(0, len(words), A_ROW), len(words)]
    lists = pa.ListArray.from_arrays(pa.array([*cuts, *[len(words)] * len(members)], pa.int32()), words)
    return pa.table([pa.array([-1] * (len(cuts) - 1) + tab.column("part").to_pylist(), pa.int64()), pa.array([b""] * (len(cuts) - 1) + members, pa.binary()), lists], names=["part", "members", "words"])


def _per_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What _bucket made, with the words' ids and bytes: for each group its words of the bucket, their ids and their bytes."""
    held: list[list[pa.Array]] = [[], [], []]
    ended = True
    for batch in batches:
        part = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.r_[True, (part[1:] < 0) != (part[:-1] < 0), True]).tolist() if len(part) else []
        parts, blobs = [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if part[a] < 0:
                if ended:
                    held, ended = [[], [], []], False
                ids = batch.column(3).slice(a, b - a).flatten()
                sizes = np.r_[0, np.cumsum(ids.value_lengths().to_numpy())].astype(np.int32) * np.int32(2)
                codes = pa.py_buffer(ids.flatten().to_numpy(zero_copy_only=False).astype("<u2").tobytes())
                own = (batch.column(2).slice(a, b - a).flatten(), pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(sizes), codes]), batch.column(4).slice(a, b - a).flatten())
                for column, values in zip(held, own):
                    column.append(values)
            else:
                ended = True
                held = [[pa.concat_arrays(column)] for column in held]
                for k in range(a, b):
                    at = pa.array(np.frombuffer(batch.column(1)[k].as_buffer(), "<u4"))
                    parts.append(int(part[k]))
                    blobs.append(_packed(*(column[0].take(at) for column in held)))
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(blobs, pa.binary())], names=["part", "blob"])
    pa.default_memory_pool().release_unused()


def _folded(group: int, most: int = 4 << 20):
    """Texts of a group, some megabytes at a time, as compressed Arrow streams: they take less room in the shuffle."""

    def fold(rows: pa.RecordBatch) -> bytes:
        sink, options = pa.BufferOutputStream(), pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
        with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
            out.write_batch(rows)
        return sink.getvalue().to_pybytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _Groups(group)
        for batch in batches:
            at = 0
            for now, texts in groups.cut(batch.column(1)):
                upto = at + len(texts)
                step = max(1, int(len(texts) * most / max(most, texts.nbytes)))
                for first in range(at, upto, step):
                    yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([fold(batch.slice(first, min(step, upto - first)))], pa.binary())], names=["part", "blob"])
                at = upto
        pa.default_memory_pool().release_unused()

    return run


def _joined(pattern: str):
    """One group: its texts and its words with their ids and bytes."""

    def encode(find: Callable[[str], list[str]], texts: pa.Array, keys: pa.Array, codes: pa.Array, raws: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
        """The ids (16 bits each) and the bytes of each text, out of those of its words; some texts at a time, in order."""
        lists = [split_texts(some) for some in _some(texts, A_TIME)]
        values, starts, first = pieces_of(pa.concat_arrays(lists) if lists else split_texts(texts))
        known = values.dictionary_encode()
        del lists, values
        place = pc.fill_null(pc.index_in(spaced_out(known.dictionary), value_set=keys), -1).to_numpy().copy()
        index = known.indices.to_numpy()
        # words of several matches, and heads, are joined up from their matches
        used = np.zeros(len(place), bool)
        used[index[~first]] = True
        other = np.flatnonzero(used & (place < 0))
        heads = np.unique(index[first])
        flat, sizes = [pa.array([], pa.binary())], []
        for own, split in ((other, lambda w: matches(find, w)), (heads, find)):
            for k in range(0, len(own), STEP):  # what is held as Python objects stays small
                found = [split(w) for w in known.dictionary.take(pa.array(own[k : k + STEP])).to_pylist()]
                flat.append(pa.array([m.encode() for ms in found for m in ms], pa.binary()))
                sizes += map(len, found)
        at = pc.index_in(pa.concat_arrays(flat), value_set=keys)
        if at.null_count:
            raise LookupError("a match is not among its group's words")
        place[other] = len(keys) + np.arange(len(other))
        of_head = np.zeros(len(place), np.int64)
        of_head[heads] = len(keys) + len(other) + np.arange(len(heads))
        where = np.where(first, of_head[index], place[index]).astype(np.int32)
        del known, index, first
        codes, raws = (pa.concat_arrays([column, joined_up(sizes, column.take(at))]) for column in (codes, raws))
        upto = 0
        for some in _some(texts, A_TIME):
            own = starts[upto : upto + len(some) + 1]
            places = pa.array(where[own[0] : own[-1]])
            yield tuple(joined_up(np.diff(own), column.take(places)) for column in (codes, raws))
            upto += len(some)

    def run(docs: pa.Table, blobs: pa.Table) -> pa.Table:
        find = regex.compile(pattern).findall
        found = [_unpacked(blob.as_py(), 3) for blob in blobs.column("blob")]
        columns = [pa.concat_arrays([x[k] for x in found]) if found else pa.array([], pa.binary()) for k in range(3)]
        out: list[list] = [[], [], [], []]
        for blob in docs.column("blob"):
            rows = pa.ipc.open_stream(blob.as_buffer()).read_all().combine_chunks()
            texts = rows.column(1).chunk(0) if rows.num_rows else pa.array([], pa.string())
            out[0] += rows.column(0).to_pylist()
            for ids, raws in encode(find, texts, *columns):
                out[1] += (pc.binary_length(ids).to_numpy() // 2).tolist()
                out[2] += [hashlib.sha256(np.frombuffer(x.as_buffer(), "<u2").astype("<u4")).hexdigest() for x in ids]
                out[3] += [hashlib.sha256(x.as_buffer()).hexdigest() for x in raws]
        del found, columns
        pa.default_memory_pool().release_unused()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.table([pa.array(x, t) for x, t in zip(out, kinds)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encoded(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", group_bytes: int = 12 << 20) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; path: the rank file."""
    ranks = read_ranks(path)
    if max(ranks.values()) > 0xFFFF:
        raise ValueError("ids above 65535 need wider slots")
    docs = stable(docs, "documents")  # the two plans below find the same groups
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    tasks, total = parts_for(docs, 64 << 20), size_of(docs)
    group = min(group_bytes, max(1 << 20, total // tasks))
    buckets = max(4 * tasks, total // (8 << 20))
    dealt = rows.select("text").mapInArrow(_distinct(pattern, group, buckets), "bucket long, part long, blob binary")
    words = encode_words(dealt.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_bucket, ROW), ranks)
    words = words.withColumn("bytes", F.transform("ids", lambda own: decode_ids(own, ranks)))
    own = words.mapInArrow(_per_group, "part long, blob binary")
    texts = rows.mapInArrow(_folded(group), "part long, blob binary")
    # numbers of partitions that grow with the input: a task reads a few groups however many there are
    both = texts.repartition(tasks, "part").groupBy("part").cogroup(own.repartition(tasks, "part").groupBy("part"))
    return both.applyInArrow(_joined(pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
