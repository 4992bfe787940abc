"""Removal of repeated passages, located by sharded Aho-Corasick automata over recurring phrases.

A word is removed if a window of ``window`` consecutive words covers it whose word sequence also starts earlier
(smaller id, or same document and earlier start).

1. Every window chooses the 8-word phrases in it with the smallest hash; equal windows choose equal phrases, so only
   phrases that recur in the corpus can hide a repeated window.  Phrases are counted by hash, with a partial sum in each
   task, and each recurring one gets a home: one of the documents that hold it.
2. Phrases of one home, which near copies of it and quotations from it hold together, share a shard of at most
   ``SHARD_PHRASES`` (homes are dealt to shards by hash, larger ones are split).  The homes supply the text of the phrases.
3. A document is sent to the shards of its phrases' homes, where an automaton of all phrases of the shard is compiled and
   the texts are streamed through it.  Only what the automaton finds in a text counts, so a phrase is confirmed where its
   text stands again; windows whose chosen phrase stands there are the candidates.  A shard that very many documents meet
   is repeated, ``SALT_DOCUMENTS`` of them each.
4. The first document of each candidate window is an aggregation by window hash; its windows go back to that document,
   and every other occurrence is removed.

Texts travel compressed, and only those that hold a recurring phrase.  Windows are compared by 64-bit hashes.
Defined results: null or empty texts have no words; null ids precede all others; of rows that share an id, the one with the
smaller hash of id and text is the earlier, and equal rows do not precede one another; columns of the input are kept, but
those named like results are replaced.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.rows import row_hash
from logweave.llm.text import free_memory, gram_hashes, hashed_words, signed, sliding_min, space_words
from logweave.plans.session import scratch, ship_package, small, written

PHRASE = 8
SHARD_PHRASES = 10_000
#: Documents that one copy of a shard's automaton reads.
SALT_DOCUMENTS = 2_000
_RESULTS = ("n_words", "n_removed", "kept_text")


def _chosen(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of phrases that have the smallest hash of some window."""
    span = window - PHRASE + 1
    least = sliding_min(grams, span)
    if not len(least):
        return np.empty(0, dtype=np.int64)
    around = np.concatenate([np.zeros(span - 1, dtype=np.uint64), least, np.zeros(span - 1, dtype=np.uint64)])
    return np.flatnonzero(~sliding_min(~around, span) == grams)


def _candidates(grams: np.ndarray, hit: np.ndarray, window: int) -> np.ndarray:
    """Starts of windows whose smallest phrase is among the hit positions."""
    span = window - PHRASE + 1
    shown = np.where(hit, grams, np.uint64((1 << 64) - 1))
    return np.flatnonzero((sliding_min(shown, span) == sliding_min(grams, span)) & (sliding_min((~hit).astype(np.uint8), span) == 0))


def _phrase_rows(source: DataFrame, window: int) -> DataFrame:
    """``phrase, r, n, lead``: each phrase chosen in a document, how often it stands at a chosen place, and whether it is the document's first row."""

    def rows(batches):
        for batch in batches:
            free_memory()
            phrases, counts, at = [], [], []
            for i, body in enumerate(batch.column(1)):
                grams = gram_hashes(hashed_words(body.as_py()), PHRASE)
                chosen = _chosen(grams, window)
                if not len(chosen):
                    continue
                values, n = np.unique(grams[chosen], return_counts=True)
                phrases.append(values)
                counts.append(n)
                at.append(np.full(len(values), i))
            if at:
                at = np.concatenate(at)
                lead = np.diff(at, prepend=-1) > 0
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(phrases))), batch.column(0).take(pa.array(at)), pa.array(np.concatenate(counts).astype(np.int32)), pa.array(lead)], ["phrase", "r", "n", "lead"])

    return source.select("r", "body").mapInArrow(rows, "phrase long, r long, n int, lead boolean")


def _routed(phrases: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """``r, sends``: the shards each document meets, with their copies, and ``r, supplies``: the phrases whose text a home gives to them."""
    recurring = written(phrases.groupBy("phrase").agg(F.sum("n").alias("n"), F.min("r").alias("home")).where("n > 1").select("phrase", "home"), "recurring", folder)
    shards = max(1, -(-recurring.count() // SHARD_PHRASES))
    parts = recurring.groupBy("home").agg(F.ceil(F.count("*") / SHARD_PHRASES).cast("int").alias("parts"))
    shard = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("home"), F.lit(shards))).otherwise(shards + F.pmod(F.xxhash64("home", F.pmod("phrase", "parts")), F.lit(1 << 62)))
    placed = written(recurring.join(parts, "home").select("phrase", "home", shard.alias("shard")), "placed", folder)
    # Rows that are equal share r; each has one phrase that leads.
    equal = phrases.where("lead").groupBy("r").agg(F.count("*").alias("rows")).where("rows > 1")
    met = phrases.select("phrase", "r").join(placed.select("phrase", "shard"), "phrase").select("shard", "r").distinct()
    pairs = written(met.join(equal, "r", "left").select("shard", "r", F.coalesce("rows", F.lit(1)).alias("rows")), "pairs", folder)
    copies = written(pairs.groupBy("shard").agg(F.ceil(F.sum("rows") / SALT_DOCUMENTS).cast("int").alias("copies")), "copies", folder)
    sends = pairs.join(copies, "shard").groupBy("r").agg(F.collect_list(F.struct("shard", "copies")).alias("sends"))
    lists = placed.groupBy("home", "shard").agg(F.collect_list("phrase").alias("phrases")).join(copies, "shard")
    supplies = lists.groupBy(F.col("home").alias("r")).agg(F.collect_list(F.struct("shard", "copies", "phrases")).alias("supplies"))
    return written(sends, "sends", folder), written(supplies, "supplies", folder)


def _supplied(source: DataFrame, supplies: DataFrame) -> DataFrame:
    """``shard, salt, body``: the text of each recurring phrase, once for every copy of its shard."""

    def rows(batches):
        for batch in batches:
            for i, wanted in enumerate(batch.column(1).to_pylist()):
                body = batch.column(0)[i].as_py()
                words = space_words(body)
                at = dict(zip(signed(gram_hashes(hashed_words(body), PHRASE)).tolist(), range(len(words)), strict=False))
                for x in wanted:
                    own = [p for p in x["phrases"] if p in at]  # another row may share the hash
                    n, texts = len(own), [b" ".join(words[at[p] : at[p] + PHRASE]) for p in own]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([x["shard"]] * n, pa.int64()), pa.array([x["copies"]] * n, pa.int32()), pa.array(texts, pa.binary())], ["phrase", "shard", "copies", "body"])

    given = source.join(small(supplies), "r").select("body", "supplies").mapInArrow(rows, "phrase long, shard long, copies int, body binary")
    once = given.groupBy("phrase").agg(*[F.first(x).alias(x) for x in ("shard", "copies", "body")])
    return once.select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), "body")


def _sent(source: DataFrame, sends: DataFrame) -> DataFrame:
    """``shard, salt, id, r, body``: documents, compressed, for one copy of each shard they meet."""
    kind = dict(source.dtypes)["id"]

    def rows(batches):
        pack, n = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId()  # so that small tasks do not all begin with the first copy
        for batch in batches:
            for first in range(0, batch.num_rows, 1_000):
                part = batch.slice(first, 1_000)
                shard, salt, at, bodies = [], [], [], []
                for i, to in enumerate(part.column(3).to_pylist()):
                    packed = pack.compress(part.column(2)[i].as_py())
                    for x in to:
                        shard.append(x["shard"])
                        salt.append(n % x["copies"])
                        at.append(i)
                        bodies.append(packed)
                    n += 1
                where = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(salt, pa.int32()), part.column(0).take(where), part.column(1).take(where), pa.array(bodies, pa.binary())], ["shard", "salt", "id", "r", "body"])

    return source.join(small(sends), "r").select("id", "r", "body", "sends").mapInArrow(rows, f"shard long, salt int, id {kind}, r long, body binary")


def _automaton(phrases: list[bytes]):
    """An automaton of the phrases, each with the spaces around it, whose values are their lengths."""
    automaton = ahocorasick.Automaton()
    for p in phrases:
        automaton.add_word(f" {p.decode('latin-1')} ", len(p) + 2)
    automaton.make_automaton()
    return automaton


def _places(automaton, words: list[bytes]) -> np.ndarray:
    """Word positions at which a phrase of the automaton stands."""
    found = [end + 1 - size for end, size in automaton.iter((b" " + b" ".join(words) + b" ").decode("latin-1"))]
    if not found:
        return np.empty(0, dtype=np.int64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return np.searchsorted(np.cumsum(sizes + 1) - (sizes + 1), np.array(found, dtype=np.int64))


def _searched(phrases: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """``id, r, starts, hashes``: the candidate windows that a shard's automaton has found in a document."""
    kind = dict(texts.dtypes)["id"]
    none = phrases.select("shard", "salt", F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("id"), F.lit(None).cast("long").alias("r"), "body")
    delivered = none.unionByName(texts.withColumn("kind", F.lit(1)))

    def rows(batches):
        at, phrases, automaton = None, [], None
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            keep, starts, hashes = [], [], []
            for i, (shard, salt, what) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True)):
                body = batch.column(5)[i].as_py()
                if at != (shard, salt):
                    at, phrases, automaton = (shard, salt), [], None
                if what == 0:
                    phrases.append(body)
                    continue
                automaton = automaton or _automaton(phrases)
                body = unpack.decompress(body)
                words, hashed = space_words(body), hashed_words(body)
                grams = gram_hashes(hashed, PHRASE)
                hit = np.zeros(len(grams), dtype=bool)
                hit[_places(automaton, words)] = True
                found = _candidates(grams, hit, window)
                if len(found):
                    keep.append(i)
                    starts.append(found.astype("<i4").tobytes())
                    hashes.append(gram_hashes(hashed, window)[found].tobytes())
            free_memory()
            where = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(3).take(where), batch.column(4).take(where), pa.array(starts, pa.binary()), pa.array(hashes, pa.binary())], ["id", "r", "starts", "hashes"])

    return delivered.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(rows, f"id {kind}, r long, starts binary, hashes binary")


def _instances(found: DataFrame) -> DataFrame:
    """``h, id, r``: candidate window hashes of each document, once each."""

    def rows(batches):
        for batch in batches:
            own = [np.unique(np.frombuffer(x.as_py(), dtype=np.uint64)) for x in batch.column(2)]
            if own:
                where = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(own))), batch.column(0).take(where), batch.column(1).take(where)], ["h", "id", "r"])

    return found.select("id", "r", "hashes").mapInArrow(rows, f"h long, id {dict(found.dtypes)['id']}, r long")


def _spans(found: DataFrame, window: int) -> DataFrame:
    """``id, r, gone``: word spans (pairs of 32-bit numbers) covered by candidate windows that aren't the first of their hash.

    Reads ``id, r, parts`` (what each shard has found) and ``firsts`` (hashes of which the document is the first).
    """

    def rows(batches):
        for batch in batches:
            gone = []
            for parts, firsts in zip(batch.column(2), batch.column(3), strict=True):
                parts = parts.as_py()
                starts = np.concatenate([np.frombuffer(x["starts"], dtype="<i4") for x in parts]).astype(np.int64)
                own = np.concatenate([np.frombuffer(x["hashes"], dtype=np.uint64) for x in parts])
                starts, once = np.unique(starts, return_index=True)
                own = own[once]
                first = np.array(firsts.as_py() or [], dtype=np.int64).view(np.uint64)
                _, earliest = np.unique(own, return_index=True)
                repeated = np.ones(len(own), dtype=bool)
                repeated[earliest] = ~np.isin(own[earliest], first)
                gone.append(_merged(starts[repeated], window).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.binary())], ["id", "r", "gone"])

    return found.select("id", "r", "parts", "firsts").mapInArrow(rows, f"id {dict(found.dtypes)['id']}, r long, gone binary")


def _merged(starts: np.ndarray, window: int) -> np.ndarray:
    """Half-open spans, one after another, that ascending windows cover."""
    if not len(starts):
        return starts
    breaks = np.flatnonzero(np.diff(starts) > window)
    return np.column_stack([starts[np.concatenate([[0], breaks + 1])], starts[np.concatenate([breaks, [len(starts) - 1]])] + window]).reshape(-1)


def repeats(source: DataFrame, window: int) -> DataFrame:
    """``id, r, gone``: what is repeated in the documents of ``source(id, r, body)``; ``r`` is a hash of id and text."""
    spark = source.sparkSession
    with scratch(spark) as folder:
        phrases = written(_phrase_rows(source, window), "phrases", folder)
        sends, supplies = _routed(phrases, folder)
        found = written(_searched(_supplied(source, supplies), _sent(source, sends), window), "found", folder)
        firsts = _instances(found).groupBy("h").agg(F.min(F.struct("id", "r")).alias("at")).groupBy("at").agg(F.collect_list("h").alias("firsts"))
        parts = found.groupBy(F.struct("id", "r").alias("at")).agg(F.collect_set(F.struct("starts", "hashes")).alias("parts"))
        joined = parts.join(firsts, "at", "left").select("at.id", "at.r", "parts", "firsts")
        return written(_spans(joined, window).where(F.length("gone") > 0), "repeats")


def _cut(text, gone):
    """Words, removed words and kept text of each text, for an Arrow function."""
    n_words, n_removed, kept = [], [], []
    for body, spans in zip(text, gone, strict=True):
        words = space_words(body.as_py())
        n_words.append(len(words))
        if spans.is_valid:
            edges = np.frombuffer(spans.as_py(), dtype="<i4").tolist()
            left = [0, *edges, len(words)]
            words = [w for a, b in zip(left[::2], left[1::2], strict=True) for w in words[a:b]]
        n_removed.append(n_words[-1] - len(words))
        kept.append(b" ".join(words))
    free_memory()
    return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], list(_RESULTS))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """Every document with ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by one space) for its text."""
    if window < PHRASE:
        raise ValueError(f"a window has at least {PHRASE} words")
    ship_package(docs.sparkSession)
    docs = docs.drop(*_RESULTS)
    row = row_hash(key, text)
    found = repeats(docs.select(F.col(key).alias("id"), row.alias("r"), F.col(text).cast("binary").alias("body")), window)
    at, gone, cut = (_unused(x, docs.columns) for x in ("_at", "_gone", "_cut"))
    sides = small(found.select(F.struct("id", "r").alias(at), F.col("gone").alias(gone)))
    cutter = F.arrow_udf(_cut, "n_words long, n_removed long, kept_text string")
    joined = docs.withColumn(cut, F.struct(F.col(key).alias("id"), row.alias("r"))).join(sides, F.col(cut).eqNullSafe(F.col(at)), "left")
    return joined.withColumn(cut, cutter(F.col(text).cast("binary"), F.col(gone))).select(*docs.columns, f"{cut}.*")


def _unused(name: str, columns: list[str]) -> str:
    """A column name that no column has."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = f"_{name}"
    return name
