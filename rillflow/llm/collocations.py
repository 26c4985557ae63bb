"""Phrases of 2 to 4 words and how firmly they hold together, counted level by level.

Documents are read once: their words become 64-bit ids of (language, word), the
texts streams of ids with zeros where a phrase can't go on. The ids are exact:
if two words share one, all begins again with another seed.

For each length, three passes over the streams:
1. a sieve: each task bincounts hashes of the phrases whose two shorter parts
   may be frequent into an array of fixed size; the arrays are summed in a tree.
   A phrase whose place has fewer than `least` can't reach `least` itself;
2. the candidates: distinct phrases that pass both filters, as tuples of ids;
3. the counts: a minimal perfect hash over the candidates gives each a slot;
   tasks look phrases up, check the key kept at the slot, bincount the slots and
   sum the arrays in a tree.

Hash and arrays are cut into slices of `slice_keys` candidates, a fixed size. One
slice is sent to where the streams are read; of several, each goes to a few tasks, and
the phrases, added up over many blocks and packed by slice, travel to it. So nothing that is sent
grows with the corpus, and the streams are read the same number of times at any
size. Where the filters of fixed size fill up, more candidates are counted; the
result is the same.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillflow.llm.perfect_hash import PerfectHash, tuple_hash
from rillflow.llm.storage import Scratch, written
from rillflow.llm.tokens import release_memory
from rillflow.llm.wordhash import U64, WordHasher, chunks, mix64, string_buffers

#: What ends a piece of text, what ends a word, the longest phrase, the factor of a score, the share that takes a part out.
ENDS_PIECE, ENDS_WORD = ".,;:!?\n\x0b\x0c\r", " \t"
LONGEST, SCALE, SHARE = 4, 2_000_000, 80

IDS = [f"w{i + 1}" for i in range(LONGEST)]
GRAMS_SQL = ", ".join(f"{c} long" for c in IDS)
BLOCK_IDS = 1 << 17
SIEVE, MEMBERS = 1 << 26, 1 << 25
ARRAY_PART = 1 << 15
#: Arrays that a task of the tree adds up: of each a part of 256 KB at most.
FAN_IN = 256
#: Words of the corpus for each bucket in which candidates meet; what tells buckets and slices apart.
WORDS_IN_BUCKET, BUCKET_SEED = 1 << 22, 77
#: Phrases that a task holds to send each once.
ROWS_HELD = 1 << 19
NO_ROWS = np.zeros(0, np.int64)


def _letters() -> np.ndarray:
    """Each byte as it is read: A-Z lower-cased, ends of pieces as line ends, ends of words as spaces."""
    read = np.arange(256, dtype=np.uint8)
    read[65:91] += 32
    read[[ord(c) for c in ENDS_PIECE]] = 10
    read[[ord(c) for c in ENDS_WORD]] = 32
    return read


LETTERS = _letters()


def _lang_hash(lang: str, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8, key=seed.to_bytes(4, "little")).digest(), "little")


class Reader:
    """Words of documents as ids."""

    def __init__(self, seed: int):
        self.seed, self.hasher = seed, WordHasher(seed)

    def read(self, texts: pa.Array, langs: pa.Array):
        """(ids with a zero after each end of a piece, distinct ids, their counts, their words, their languages) of consecutive documents."""
        raw, offsets = string_buffers(texts)
        data = LETTERS[raw]
        solid = (data != 32) & (data != 10)
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        first = offsets[:-1][offsets[:-1] < len(data)]
        begins[first] = solid[first]
        starts = np.flatnonzero(begins)
        bounds = np.append(starts, len(data)).astype(np.int32 if len(data) < 2**31 else np.int64)
        kind = pa.string() if bounds.dtype == np.int32 else pa.large_string()
        # A word with what follows it up to the next word; few forms of a word differ in that.
        forms = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        words = pc.ascii_rtrim(forms.dictionary, characters=" \n").dictionary_encode()
        ends = pc.match_substring(forms.dictionary, "\n").to_numpy(zero_copy_only=False)
        codes = forms.indices.to_numpy()
        letters, at = string_buffers(words.dictionary)
        hashes = self.hasher.words(letters, at[:-1], at[1:]) if len(words.dictionary) else np.zeros(0, U64)
        of_form = words.indices.to_numpy()
        langs = langs.dictionary_encode()
        own = np.array([_lang_hash(lang, self.seed) for lang in langs.dictionary.to_pylist()], U64)
        doc = np.searchsorted(offsets, starts, "right") - 1
        lang_code = langs.indices.to_numpy()[doc]
        ids = mix64(hashes[of_form[codes]] ^ own[lang_code])
        ids[ids == 0] = 1
        distinct, where, counts = np.unique(ids, return_index=True, return_counts=True)
        last = np.flatnonzero(ends[codes] | np.append(doc[1:] != doc[:-1], True)[: len(codes)])
        stream = np.insert(ids, last + 1, U64(0))
        return stream, distinct, counts, words.dictionary.take(pa.array(of_form[codes[where]])), langs.dictionary.take(pa.array(lang_code[where]))


READ = pa.schema([("id", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("repeated", pa.int32()), ("ids", pa.binary())])
READ_SQL = "id long, lang string, word string, n long, repeated int, ids binary"


def _words_and_streams(seed: int):
    def run(batches):
        reader = Reader(seed)
        for batch in batches:
            found = []
            for a, b in chunks(string_buffers(batch["text"])[1]):
                stream, *words = reader.read(batch["text"].slice(a, b - a), batch["lang"].slice(a, b - a))
                found.append(words)
                for at in range(0, len(stream), BLOCK_IDS):
                    # What a phrase that ends in this block needs from the one before is repeated.
                    lead = min(at, LONGEST - 1)
                    block = stream[at - lead : at + BLOCK_IDS].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([lead], pa.int32()), pa.array([block])], schema=READ)
            if found:
                yield _words(found)
            del found
            release_memory()

    return run


def _words(found: list) -> pa.RecordBatch:
    """The words of several readings, each once."""
    ids, counts = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    distinct, where, place = np.unique(ids, return_index=True, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, place, counts)
    words, langs = (pa.concat_arrays([f[i].cast(pa.large_string()) for f in found]).take(pa.array(where)).cast(pa.string()) for i in (2, 3))
    n = len(distinct)
    return pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), langs, words, pa.array(total), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=READ)


class Filters:
    """What is known of phrases of `k` words before they are counted: places of frequent shorter ones, and of the sieve."""

    def __init__(self, k: int, members: np.ndarray, sieve: np.ndarray | None = None):
        self.k, self.members, self.sieve = k, members, sieve

    @staticmethod
    def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        place = (hashes & U64(len(bits) * 8 - 1)).astype(np.int64)
        return bits[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1

    def phrases(self, ids: np.ndarray, repeated: int) -> tuple[np.ndarray, np.ndarray]:
        """(first place, hash) of each phrase of a block that may be frequent."""
        k, n = self.k, len(ids) - self.k + 1
        if n <= 0:
            return NO_ROWS, np.zeros(0, U64)
        whole = ids[:n] != 0
        for j in range(1, k):
            whole &= ids[j : j + n] != 0
        whole[: max(0, repeated - k + 1)] = False
        part = self.has(self.members, tuple_hash([ids[j : j + n + 1] for j in range(k - 1)]))
        at = np.flatnonzero(whole & part[:-1] & part[1:])
        hashes = tuple_hash([ids[at + j] for j in range(k)])
        if self.sieve is not None:
            some = self.has(self.sieve, hashes)
            at, hashes = at[some], hashes[some]
        return at, hashes


def _columns(ids: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    return [ids[at + j] if j < k else np.zeros(len(at), U64) for j in range(LONGEST)]


def _blocks(batches):
    for batch in batches:
        for repeated, block in zip(batch["repeated"].to_pylist(), batch["ids"]):
            yield np.frombuffer(block.as_buffer(), U64), repeated


ARRAYS_SQL = "slice int, part long, task int, places binary, counts binary"
ARRAYS = pa.schema([("slice", pa.int32()), ("part", pa.int64()), ("task", pa.int32()), ("places", pa.binary()), ("counts", pa.binary())])


def _packed(counts: np.ndarray) -> tuple:
    """(places, counts) of a part of an array: of what isn't zero alone, if that is little."""
    some = np.flatnonzero(counts).astype(np.int32)
    return (some.tobytes(), counts[some].tobytes()) if len(some) * 6 < len(counts) else (None, counts.tobytes())


def _unpacked(places, counts, kind, size: int) -> np.ndarray:
    values = np.frombuffer(counts.as_buffer(), kind)
    if not places.is_valid:
        return values.astype(np.int64)
    out = np.zeros(size, np.int64)
    out[np.frombuffer(places.as_buffer(), np.int32)] = values
    return out


def _array_rows(counts: np.ndarray, number: int):
    """The parts of a task's array that hold anything."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    for part in range(0, len(counts), ARRAY_PART):
        if not counts[part : part + ARRAY_PART].any():
            continue
        places, own = _packed(counts[part : part + ARRAY_PART])
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([part], pa.int64()), pa.array([task], pa.int32()), pa.array([places], pa.binary()), pa.array([own], pa.binary())], schema=ARRAYS)


def tree_sum(arrays: DataFrame, kind, tasks: int) -> DataFrame:
    """The sums of the arrays of about `tasks` tasks, part by part: of at most FAN_IN tasks, then of as many such sums, until one is left."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(ARRAY_PART, np.int64)
        for places, own in zip(table["places"], table["counts"]):
            values = _unpacked(places, own, kind, ARRAY_PART)
            total[: len(values)] += values
        if kind == np.uint8:  # what has reached the limit stays there
            total = np.minimum(total, 255)
        places, own = _packed(total.astype(kind))
        return pa.table([table["slice"][:1], table["part"][:1], table["task"][:1], pa.array([places], pa.binary()), pa.array([own], pa.binary())], schema=ARRAYS)

    while tasks > FAN_IN:
        arrays = arrays.withColumn("task", F.expr(f"task div {FAN_IN}").cast("int")).groupBy("slice", "part", "task").applyInArrow(add, ARRAYS_SQL)
        tasks = -(-tasks // FAN_IN)
    return arrays.groupBy("slice", "part").applyInArrow(add, ARRAYS_SQL)


def _tasks(table: DataFrame) -> int:
    """How many tasks read a written table."""
    return table.rdd.getNumPartitions()


def _bits(arrays: DataFrame, size: int, least: int, tasks: int) -> np.ndarray:
    """The places of a summed array of `size` that have `least`, as bits: 1 MB for 8 million places, whatever was counted."""

    def pack(batches):
        for batch in batches:
            bits = [np.packbits(_unpacked(places, own, np.uint8, ARRAY_PART) >= least, bitorder="little").tobytes() for places, own in zip(batch["places"], batch["counts"])]
            yield pa.RecordBatch.from_arrays([batch["part"], pa.array(bits, pa.binary())], names=["part", "bits"])

    out = np.zeros(size // 8, np.uint8)
    for r in tree_sum(arrays, np.uint8, tasks).mapInArrow(pack, "part long, bits binary").toLocalIterator():
        bits = np.frombuffer(r.bits, np.uint8)[: len(out) - r.part // 8]
        out[r.part // 8 : r.part // 8 + len(bits)] = bits
    return out


def _member_bits(grams: DataFrame, k: int, size: int) -> np.ndarray:
    """The places of the hashes of all rows of `grams`, phrases of `k` words."""

    def mark(batches):
        seen = np.zeros(size, np.uint8)
        for batch in batches:
            seen[(tuple_hash([batch[c].to_numpy().view(U64) for c in IDS[:k]]) & U64(size - 1)).astype(np.int64)] = 1
        yield from _array_rows(seen, 0)

    grams = grams.select(*IDS[:k])
    return _bits(grams.mapInArrow(mark, ARRAYS_SQL), size, 1, _tasks(grams))


def _sieve_bits(streams: DataFrame, filters, size: int, least: int) -> np.ndarray:
    def count(batches):
        total = np.zeros(size, np.uint8)  # what has reached 255 stays there
        for ids, repeated in _blocks(batches):
            places, n = np.unique((filters.value.phrases(ids, repeated)[1] & U64(size - 1)).astype(np.int64), return_counts=True)
            total[places] = np.minimum(total[places] + n, 255)
        yield from _array_rows(total, 0)
        del total
        release_memory()

    return _bits(streams.mapInArrow(count, ARRAYS_SQL), size, least, _tasks(streams))


def _distinct_rows(columns: list[np.ndarray], hashes: np.ndarray, counts: np.ndarray | None = None):
    """(columns, counts) of rows, each once (or more often where hashes clash)."""
    order = np.argsort(hashes, kind="stable")
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    if counts is None:
        return [c[first] for c in columns], np.diff(np.append(first, len(order)))
    return [c[first] for c in columns], np.add.reduceat(counts[order], first) if len(first) else counts


def _added_up(batches, filters: Filters):
    """Yield (columns, counts) of the phrases that pass the filters, added up over as many blocks as a task may hold."""
    held, size = [], 0

    def merged():
        columns = [np.concatenate([h[0][i] for h in held]) for i in range(LONGEST)]
        return _distinct_rows(columns, tuple_hash(columns), np.concatenate([h[1] for h in held]))

    for ids, repeated in _blocks(batches):
        at, hashes = filters.phrases(ids, repeated)
        held.append(_distinct_rows(_columns(ids, at, filters.k), hashes))
        size += len(held[-1][1])
        if size > ROWS_HELD:
            held = [merged()]
            if len(held[0][1]) > ROWS_HELD // 2:
                yield held.pop()
            size = sum(len(h[1]) for h in held)
    if held:
        yield merged()


BLOCK_SQL = "bucket int, keys binary, n binary"
BLOCK = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])


def _bucket(columns: list[np.ndarray]) -> np.ndarray:
    """What says to which bucket or slice a phrase belongs, as a signed number."""
    return tuple_hash(columns, BUCKET_SEED).view(np.int64)


def _packed_blocks(columns: list[np.ndarray], counts: np.ndarray, buckets: int):
    """Phrases with their counts as a row for each bucket: far fewer rows travel than phrases."""
    place = np.mod(_bucket(columns), buckets)
    order = np.argsort(place, kind="stable")
    cuts = np.flatnonzero(np.diff(place[order])) + 1
    keys, counts = np.column_stack(columns)[order], counts[order].astype(np.int64)
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)]):
        if b > a:
            yield pa.RecordBatch.from_arrays([pa.array([place[order[a]]], pa.int32()), pa.array([keys[a:b].tobytes()]), pa.array([counts[a:b].tobytes()])], schema=BLOCK)


def _block_keys(block) -> list[np.ndarray]:
    return list(np.frombuffer(block.as_buffer(), U64).reshape(-1, LONGEST).T)


def _candidates(streams: DataFrame, filters, words: int) -> DataFrame:
    """The distinct phrases that pass the filters, as (w1, ..., w4), zeros at the end, and their bucket number.

    They meet in buckets of a few million of the corpus's `words` each.
    """
    buckets = max(1, -(-words // WORDS_IN_BUCKET))

    def send(batches):
        for columns, n in _added_up(batches, filters.value):
            yield from _packed_blocks(columns, n, buckets)
        release_memory()

    def once(held):
        columns = [np.concatenate([h[i] for h in held]) for i in range(LONGEST)]
        return _distinct_rows(columns, tuple_hash(columns))[0]

    def meet(batches):
        now, held, size = None, [], 0
        for batch in batches:
            for bucket, block in zip(batch["bucket"].to_pylist(), batch["keys"]):
                if bucket != now and held:
                    yield _gram_rows(once(held))
                    held, size = [], 0
                now = bucket
                held.append(_block_keys(block))
                size += len(held[-1][0])
                if size > 2 * ROWS_HELD:
                    held = [once(held)]
                    size = len(held[0][0])
        if held:
            yield _gram_rows(once(held))
        del held
        release_memory()

    sent = streams.mapInArrow(send, BLOCK_SQL).select("bucket", "keys")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, f"{GRAMS_SQL}, place long")


def _gram_rows(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns), pa.array(_bucket(columns))], names=[*IDS, "place"])


HASH_SQL = "slice int, hash binary"


def _hashes(grams: DataFrame) -> DataFrame:
    """(slice, hash): a minimal perfect hash of each slice's rows."""

    def build(table: pa.Table) -> pa.Table:
        keys = np.column_stack([table[c].to_numpy().view(U64) for c in IDS])
        return pa.table([table["slice"][:1], pa.array([PerfectHash.build(keys).to_bytes()])], names=["slice", "hash"])

    return grams.groupBy("slice").applyInArrow(build, HASH_SQL)


def _sliced(grams: DataFrame, slices: int) -> DataFrame:
    return grams.withColumn("slice", F.pmod(F.xxhash64(*IDS), F.lit(slices)).cast("int"))


def _count_here(streams: DataFrame, filters, perfect) -> DataFrame:
    """Arrays of counts by slot of the one slice, counted where the streams are read."""

    def run(batches):
        table, k = PerfectHash.from_bytes(perfect.value), filters.value.k
        total = np.zeros(len(table.keys), np.int64)
        for ids, repeated in _blocks(batches):
            slots = table.slots(_columns(ids, filters.value.phrases(ids, repeated)[0], k))
            total += np.bincount(slots[slots >= 0], minlength=len(total))
        yield from _array_rows(total, 0)
        del total, table
        release_memory()

    return streams.mapInArrow(run, ARRAYS_SQL)


def _count_there(streams: DataFrame, filters, hashes: DataFrame, slices: int, salts: int) -> DataFrame:
    """Arrays of counts by slot of many slices: phrases travel to one of the `salts` tasks that hold their slice."""

    def send(batches):
        for columns, n in _added_up(batches, filters.value):
            yield from _packed_blocks(columns, n, slices)
        release_memory()

    def run(batches):
        now, table, total = None, None, None
        for batch in batches:
            for number, found, keys, n in zip(batch["bucket"].to_pylist(), batch["hash"], batch["keys"], batch["n"]):
                if found.is_valid:  # sorted first: the hash of the slice whose phrases come now
                    if now is not None:
                        yield from _array_rows(total, now)
                    now, table = number, PerfectHash.from_bytes(found.as_py())
                    total = np.zeros(len(table.keys), np.int64)
                    continue
                slots, n = table.slots(_block_keys(keys)), np.frombuffer(n.as_buffer(), np.int64)
                np.add.at(total, slots[slots >= 0], n[slots >= 0])
        if now is not None:
            yield from _array_rows(total, now)
        del table, total
        release_memory()

    salt = F.pmod(F.xxhash64("keys"), F.lit(salts)).cast("int")
    grams = streams.mapInArrow(send, BLOCK_SQL).select("bucket", salt.alias("salt"), F.lit(None).cast("binary").alias("hash"), "keys", "n")
    none = F.lit(None).cast("binary")
    held = hashes.select(F.col("slice").alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "hash", none.alias("keys"), none.alias("n"))
    both = grams.union(held).repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", F.col("hash").isNull())
    return both.select("bucket", "hash", "keys", "n").mapInArrow(run, ARRAYS_SQL)


def _read_out(hashes: DataFrame, arrays: DataFrame, least: int, tasks: int) -> DataFrame:
    """(w1, ..., w4, f) of the slots that have at least `least`."""

    def run(table: pa.Table, counts: pa.Table) -> pa.Table:
        perfect = PerfectHash.from_bytes(table["hash"][0].as_py())
        total = np.zeros(len(perfect.keys), np.int64)
        for part, places, own in zip(counts["part"].to_pylist(), counts["places"], counts["counts"]):
            values = _unpacked(places, own, np.int64, ARRAY_PART)[: len(total) - part]
            total[part : part + len(values)] = values
        some = np.flatnonzero(total >= least)
        return pa.table([*(pa.array(np.ascontiguousarray(perfect.keys[some, i]).view(np.int64)) for i in range(LONGEST)), pa.array(total[some])], names=[*IDS, "f"])

    return hashes.groupBy("slice").cogroup(tree_sum(arrays, np.int64, tasks).groupBy("slice")).applyInArrow(run, f"{GRAMS_SQL}, f long")


def _cuts(frequent: DataFrame, slices: int) -> DataFrame:
    """(w1, ..., w4, cut, l, r): the counts of both parts of each phrase at each cut, read by slot.

    A slice's hash and counts come to its task with the parts that ask for them.
    """

    def run(kept: pa.Table, asked: pa.Table) -> pa.Table:
        perfect = PerfectHash.build(np.column_stack([kept[c].to_numpy().view(U64) for c in IDS]))
        counts = np.zeros(len(perfect.keys), np.int64)
        counts[perfect.slots([kept[c].to_numpy().view(U64) for c in IDS])] = kept["f"].to_numpy()
        slots = perfect.slots([asked[f"p{i}"].to_numpy().view(U64) for i in range(LONGEST)])
        assert (slots >= 0).all(), "a part of a frequent phrase is frequent"
        return asked.select([*IDS, "cut", "side"]).append_column("f", pa.array(counts[slots]))

    ids = F.array(*IDS)
    phrases = frequent.where("w2 <> 0").select(*IDS, ids.alias("ids"), F.expr("size(filter(array(w1, w2, w3, w4), w -> w <> 0))").alias("k"))
    asked = phrases.select(*IDS, "ids", "k", F.explode(F.expr("sequence(1, k - 1)")).alias("cut")).select("*", F.explode(F.array(F.lit("l"), F.lit("r"))).alias("side"))
    part = F.expr("CASE side WHEN 'l' THEN slice(ids, 1, cut) ELSE slice(ids, cut + 1, k - cut) END")
    padded = F.concat(part, F.array_repeat(F.lit(0).cast("long"), LONGEST))
    asked = asked.select(*IDS, "cut", "side", padded.alias("p")).select(*IDS, "cut", "side", *(F.col("p")[i].alias(f"p{i}") for i in range(LONGEST)))
    asked = asked.withColumn("slice", F.pmod(F.xxhash64(*(f"p{i}" for i in range(LONGEST))), F.lit(slices)).cast("int"))
    # As many parts ask for a common word as there are phrases with it: each part is read once.
    once = asked.select("slice", *(f"p{i}" for i in range(LONGEST))).distinct().select("slice", *(F.col(f"p{i}") for i in range(LONGEST)), *(F.col(f"p{i}").alias(c) for i, c in enumerate(IDS)), F.lit(0).alias("cut"), F.lit("").alias("side"))
    counted = _sliced(frequent, slices).groupBy("slice").cogroup(once.groupBy("slice")).applyInArrow(run, f"{GRAMS_SQL}, cut int, side string, f long")
    parts = counted.select(*(F.col(c).alias(f"p{i}") for i, c in enumerate(IDS)), "f")
    both = asked.drop("slice").join(parts, [f"p{i}" for i in range(LONGEST)])
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("f"))).alias(s)
    return both.groupBy(*IDS, "cut").agg(side("l"), side("r"))


def _held_in_longer(frequent: DataFrame) -> DataFrame:
    """(w1, ..., w4, longer): the largest count of a longer frequent phrase that holds the phrase."""
    ids = frequent.where("w3 <> 0").select("f", F.expr("filter(array(w1, w2, w3, w4), w -> w <> 0)").alias("ids"))
    inner = F.expr("flatten(transform(sequence(2, size(ids) - 1), n -> transform(sequence(1, size(ids) - n + 1), i -> concat(slice(ids, i, n), array_repeat(0L, 4 - n)))))")
    return ids.select("f", F.explode(inner).alias("p")).groupBy(*(F.col("p")[i].alias(c) for i, c in enumerate(IDS))).agg(F.max("f").alias("longer"))


def phrase_counts(docs: DataFrame, least: int = 30, slice_keys: int = 1 << 18, sieve: int = SIEVE, members: int = MEMBERS, salts: int = 4, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(words, frequent): words as (id, lang, word, n), and all phrases of up to 4 words found at least `least` times as (w1, ..., w4, f).

    `slice_keys` bounds a slice of a perfect hash, `sieve` and `members` are the
    places of the two filters (powers of two, 8 to a byte of what is sent, so 8 and
    4 MB). A task's arrays travel as places and counts where few are taken.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    while True:
        read = scratch.write(texts.mapInArrow(_words_and_streams(seed), READ_SQL))
        words = scratch.write(read.where("id IS NOT NULL").groupBy("id", "lang", "word").agg(F.sum("n").alias("n")), narrow=True)
        if not words.groupBy("id").agg(F.count(F.lit(1)).alias("names")).where("names > 1").limit(1).count():
            break
        seed += 1
    streams = read.where("ids IS NOT NULL").select("repeated", "ids")
    total = words.agg(F.sum("n")).first()[0] or 0
    levels = [scratch.write(words.where(F.col("n") >= least).select(F.col("id").alias("w1"), *(F.lit(0).cast("long").alias(c) for c in IDS[1:]), F.col("n").alias("f")), narrow=True)]
    for k in range(2, LONGEST + 1):
        member_bits = _member_bits(levels[-1], k - 1, members)
        filters = spark.sparkContext.broadcast(Filters(k, member_bits))
        sieved = spark.sparkContext.broadcast(Filters(k, member_bits, _sieve_bits(streams, filters, sieve, least)))
        candidates = scratch.write(_candidates(streams, sieved, total), narrow=True)
        slices = max(1, -(-candidates.count() // slice_keys))
        tasks = _tasks(streams) if slices == 1 else int(spark.conf.get("spark.sql.shuffle.partitions"))
        hashes = scratch.write(_hashes(candidates.withColumn("slice", F.pmod("place", F.lit(slices)).cast("int"))))
        if slices == 1:
            held = hashes.first()
            arrays = _count_here(streams, sieved, spark.sparkContext.broadcast(bytes(held.hash))) if held else None
        else:
            arrays = _count_there(streams, sieved, hashes, slices, salts)
        levels.append(scratch.write(_read_out(hashes, arrays, least, tasks), narrow=True) if arrays is not None else levels[0].limit(0))
    frequent = levels[0]
    for level in levels[1:]:
        frequent = frequent.union(level)
    out = written(words, "words", narrow=True), written(frequent, "phrases", narrow=True)
    scratch.close()
    return out


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, slice_keys: int = 1 << 18, **settings) -> DataFrame:
    """The `top` phrases of 2 to 4 words of each language by score: lang, rank, phrase, a, l, r, n, score.

    Phrases lie within a piece of a document's text; a is the phrase's count, l and
    r those of its two parts at the cut with the lowest score (the smallest of
    equal ones), n all words of the language. Phrases within a longer one that
    is found at least 0.8 times as often are left out. A null text is empty, a
    null language is `und`; repeated rows count repeatedly; other columns are
    ignored; an empty table gives none.
    """
    words, frequent = phrase_counts(docs, least, slice_keys, **settings)
    slices = max(1, -(-frequent.count() // slice_keys))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = _cuts(frequent, slices).join(frequent, IDS).withColumn("score", F.expr(f"cast(f AS decimal(20,0)) * {SCALE} div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0)))"))
    lowest = cuts.groupBy(*IDS).agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "cut")).alias("x"), F.first("f").alias("a"))
    held = _held_in_longer(frequent)
    alone = lowest.join(held, IDS, "left").where(F.col("longer").isNull() | (exact("longer") * 100 < exact("a") * SHARE))
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    first = words.select(F.col("id").alias("w1"), "lang", F.col("word").alias("t1"))
    rows = alone.join(first, "w1").select("lang", *IDS, "t1", "a", "x.l", "x.r", "x.score")
    # Ties of the last place stay until their phrases are known.
    best = rows.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= top)
    for i, c in enumerate(IDS[1:], 2):
        best = best.join(words.select(F.col("id").alias(c), F.col("word").alias(f"t{i}")), c, "left")
    best = best.withColumn("phrase", F.concat_ws(" ", *(f"t{i + 1}" for i in range(LONGEST))))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
