"""A unigram language model over the subword lattice of an existing vocabulary.

A text is its words (A-Z in lower case) and one end; each word, with a space before it, is a lattice whose edges are the pieces of
the vocabulary and, as a way through any text, single bytes.  The probability of a word is the sum over all its segmentations, found
by the forward recursion in log space; the probability of a text is the product over its words and the end.

Weights start from the scores of the vocabulary file, which weigh in as a prior, and are fitted to the training documents by
expectation and maximisation (forward and backward over every different training word, weighted by its count).  The pieces
themselves are never changed.

Words are counted over all documents in one shuffle; lattices are walked once for each different word.  To score documents, words that
are among the most frequent (a table of fixed size) are looked up inside the task; all other words of a document go to a join with the
table of all words.  Fitting brings one row for each piece of the vocabulary to the driver.

Defined results: a null text is empty and has its end alone; a null id counts as an empty text in the choice of training documents;
rows are scored each for itself; with no training document the base probability of every token is 1 of 1 and the weights
are those of the vocabulary; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.text import free_memory
from logweave.llm.tokens import ragged
from logweave.plans.session import scratch, ship_package, small, written

#: Rounds of expectation and maximisation.
ROUNDS = 2
#: Words that tasks look up themselves: the most frequent of at most so many bytes each.
HEAD_WORDS, HEAD_BYTES = 131_072, 64
#: Bytes of words whose lattices are walked together; longer words stand alone.
LATTICE_BYTES = 1 << 16


@dataclass(frozen=True)
class Vocabulary:
    """Spans of bytes (the space before a word is one) and where their prior comes from; entry 0 is the end."""

    spans: list[bytes]
    prior: np.ndarray


def vocabulary(path: str, scores: str = "rank") -> Vocabulary:
    """The pieces that can stand in a word, and every single byte, of a sentencepiece file.

    ``scores``: "rank" where the file's scores are falling merge ranks (0, -1, -2, ...), whose prior is 1 / (1 + rank); "log" where
    they are log probabilities.  A byte that is no piece gets the least prior.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    held: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            piece = model.id_to_piece(i).replace("▁", " ").encode()
            if b" " not in piece[1:]:
                score = model.get_score(i)
                held[piece] = 1 / (1 - score) if scores == "rank" else math.exp(score)
    least = min(held.values(), default=1.0)
    for b in range(256):
        held.setdefault(bytes([b]), least)
    prior = np.array([max(held.values()), *held.values()])
    return Vocabulary([b"", *held], prior / prior.sum())


class Lattice:
    """Sums over all segmentations of words, for weights of the entries of a vocabulary."""

    def __init__(self, spans: list[bytes]) -> None:
        keys, entry, known = {}, [-1], {b"": 0}
        for e, span in enumerate(spans):
            at = 0
            for i, b in enumerate(span):
                head = span[: i + 1]
                if head not in known:
                    known[head] = len(entry)
                    keys[at * 256 + b] = len(entry)
                    entry.append(-1)
                at = known[head]
            if span:
                entry[at] = e
        order = sorted(keys)
        self.keys, self.child = np.array(order, dtype=np.int64), np.array([keys[k] for k in order], dtype=np.int64)
        self.entry = np.array(entry, dtype=np.int64)
        self.entries = len(spans)

    def edges(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and entry of all pieces inside words; ``ends`` has the end of each byte's word."""
        at, node, size = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int64), 0
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(at):
            key = node * 256 + codes[at + size]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[found] == key
            at, node, size = at[on], self.child[found[on]], size + 1
            held = self.entry[node]
            is_piece = held >= 0
            out.append((at[is_piece], at[is_piece] + size, held[is_piece]))
            more = at + size < ends[at]
            at, node = at[more], node[more]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.empty(0, dtype=np.int64) for _ in range(3))

    @staticmethod
    def _grouped(offsets: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
        """Edges by the step of their word at which they count, and in a step by what they add up to."""
        order = np.lexsort((targets, offsets))
        offsets, targets = offsets[order], targets[order]
        steps = np.flatnonzero(np.diff(offsets, prepend=-1))
        heads = np.flatnonzero(np.diff(targets, prepend=-1) | np.diff(offsets, prepend=-1))
        spans = zip(steps.tolist(), [*steps[1:].tolist(), len(order)], strict=True)
        return order, [(a, b, heads[np.searchsorted(heads, a) : np.searchsorted(heads, b)] - a) for a, b in spans]

    def walk(self, words: list[bytes], weights: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural logarithm of each word's probability; with ``counts``, how often each entry is expected in so many of the words."""
        lengths = np.array([len(w) + 1 for w in words], dtype=np.int64)
        codes = np.frombuffer(b"".join(b" " + w for w in words), dtype=np.uint8).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        word = np.repeat(np.arange(len(words)), lengths)
        a, b, entry = self.edges(codes, (starts + lengths)[word])
        own = word[a]
        source, target, weight = a + own, b + own, weights[entry]  # each word has one place more than bytes
        first = starts + np.arange(len(words))
        forward = np.full(len(codes) + len(words), -np.inf)
        forward[first] = 0.0
        order, steps = self._grouped(target - first[own], target)
        s, t, w = source[order], target[order], weight[order]
        for x, y, heads in steps:
            forward[t[x:y][heads]] = np.logaddexp.reduceat(forward[s[x:y]] + w[x:y], heads)
        total = forward[first + lengths]
        if counts is None:
            return total, None
        backward = np.full(len(forward), -np.inf)
        backward[first + lengths] = 0.0
        order, steps = self._grouped((first + lengths)[own] - source, source)
        s, t, w = source[order], target[order], weight[order]
        for x, y, heads in steps:
            backward[s[x:y][heads]] = np.logaddexp.reduceat(backward[t[x:y]] + w[x:y], heads)
        times = np.exp(forward[source] + weight + backward[target] - total[own]) * counts[own]
        return total, np.bincount(entry, weights=times, minlength=self.entries)


@lru_cache(maxsize=2)
def _lattice(path: str, scores: str) -> Lattice:
    return Lattice(vocabulary(path, scores).spans)


def _runs(words: pa.Array, limit: int = LATTICE_BYTES):
    """Words sorted by length and cut into runs of bounded bytes, with their places."""
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    order = np.argsort(sizes, kind="stable")
    total = np.cumsum(sizes[order])
    first = 0
    while first < len(order):
        before = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield order[first:last], words.take(pa.array(order[first:last])).to_pylist()
        first = last


def held_out(key: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text, modulo 7, is 2."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 7 == 2


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of words of each text, and all words in lower case."""
    plain = pc.fill_null(texts, b"").view(pa.string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(plain))
    flat = lists.flatten()
    inside = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    edges = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    total = np.concatenate([[0], np.cumsum(inside)])
    return np.diff(total[edges]), flat.filter(pa.array(inside)).view(pa.binary())


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n, trained``: how often each word stands in all documents and in the training ones."""
    ship_package(docs.sparkSession)

    def count(batches):
        for batch in batches:
            sizes, words = _words(batch.column(0))
            named = words.dictionary_encode()
            codes = named.indices.to_numpy()
            trained = np.repeat(~batch.column(1).to_numpy(zero_copy_only=False), sizes)
            n = np.bincount(codes, minlength=len(named.dictionary))
            own = np.bincount(codes[trained], minlength=len(named.dictionary))
            yield pa.RecordBatch.from_arrays([named.dictionary, pa.array(n), pa.array(own)], ["word", "n", "trained"])
            del words, named, codes, trained
            free_memory()

    rows = docs.select(F.col(text).cast("binary"), held_out(key))
    return rows.mapInArrow(count, "word binary, n long, trained long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("trained").alias("trained"))


def fit_weights(words: DataFrame, documents: int, path: str, scores: str = "rank", rounds: int = ROUNDS) -> np.ndarray:
    """Natural logarithms of the weights of a vocabulary's entries, fitted to ``word, trained`` and as many ends as training documents.

    The prior counts as one occurrence for each entry on average.
    """
    ship_package(words.sparkSession)
    known = vocabulary(path, scores)
    weights = np.log(known.prior)
    for _ in range(rounds):
        own = weights

        def expect(batches, own=own):
            lattice = _lattice(path, scores)
            total = np.zeros(lattice.entries)
            for batch in batches:
                counts = batch.column(1).to_numpy()
                for at, part in _runs(batch.column(0)):
                    total += lattice.walk(part, own, counts[at].astype(float))[1]
            entry = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(entry), pa.array(total[entry])], ["entry", "times"])
            free_memory()

        found = words.where("trained > 0").select("word", "trained").mapInArrow(expect, "entry long, times double").groupBy("entry").agg(F.sum("times").alias("times")).toArrow()
        times = np.zeros(len(known.spans))
        times[found.column("entry").to_numpy()] = found.column("times").to_numpy()
        times[0] = documents
        times += len(times) * known.prior
        weights = np.log(times / times.sum())
    return weights


def lexicon(words: DataFrame, weights: np.ndarray, path: str, scores: str = "rank") -> DataFrame:
    """``word, n, trained, log10_p``: the lattice of every different word, walked once."""
    ship_package(words.sparkSession)

    def walk(batches):
        lattice = _lattice(path, scores)
        for batch in batches:
            out = np.empty(batch.num_rows)
            for at, part in _runs(batch.column(0)):
                out[at] = lattice.walk(part, weights)[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out / math.log(10))], ["word", "n", "trained", "log10_p"])
        free_memory()

    return words.select("word", "n", "trained").mapInArrow(walk, "word binary, n long, trained long, log10_p double")


def _head(words: DataFrame) -> DataFrame:
    """``word, trained, log10_p`` of the most frequent short words, ``HEAD_WORDS`` at most.

    Words are counted by sixteenths of the logarithm of their frequency, so no task sorts them and what reaches the driver is bounded.
    """
    level = F.floor(F.log2(F.col("n").cast("double")) * 16)
    short = words.where(F.length("word") <= HEAD_BYTES)
    total, least = 0, None
    for row in sorted(short.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        total += row["n"]
        if total > HEAD_WORDS:
            break
        least = row["level"]
    return short.where(F.lit(False) if least is None else level >= least).select("word", "trained", "log10_p")


_PLACED = "pid int, row int, doc_id {}, held_out boolean, n_tokens long, known long, base double, lattice double, word binary, times int"


def _looked_up(docs: DataFrame, words: DataFrame, key: str, text: str) -> DataFrame:
    """For each document what its frequent words add up to (``word`` is null), and a row for each of its other words."""
    spark = docs.sparkSession
    head = _head(words).toArrow().combine_chunks()
    names = head.column("word").combine_chunks() if len(head) else pa.array([], pa.binary())
    trained = head.column("trained").to_numpy()
    shared = spark.sparkContext.broadcast((names, trained > 0, np.log10(trained + 1.0), head.column("log10_p").to_numpy()))
    shape = _PLACED.format(dict(docs.dtypes)[key])

    def look_up(batches):
        names, seen, base, lattice = shared.value
        pid, first = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            sizes, words = _words(batch.column(1))
            named = words.dictionary_encode()
            places = pc.fill_null(pc.index_in(named.dictionary, value_set=names), -1).to_numpy().astype(np.int64)
            codes, doc = named.indices.to_numpy(), np.repeat(np.arange(n), sizes)
            place = places[codes]
            frequent = place >= 0
            at, own = place[frequent], doc[frequent]
            known, sums, logs = (np.bincount(own, weights=x[at], minlength=n) for x in (seen, base, lattice))
            pairs, times = np.unique(doc[~frequent] * len(named.dictionary) + codes[~frequent], return_counts=True)
            rare, whose = named.dictionary.take(pa.array(pairs % max(1, len(named.dictionary)))), pairs // max(1, len(named.dictionary))
            row = pa.array((first + np.arange(n)).astype(np.int32))
            columns = [pa.array(np.full(n, pid, dtype=np.int32)), row, batch.column(0), batch.column(2), pa.array(sizes + 1), pa.array(known.astype(np.int64)), pa.array(sums), pa.array(logs), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32())]
            heads = ["pid", "row", "doc_id", "held_out", "n_tokens", "known", "base", "lattice", "word", "times"]
            yield pa.RecordBatch.from_arrays(columns, heads)
            m = len(pairs)
            kinds = [x.type for x in columns]
            tail = [pa.array(np.full(m, pid, dtype=np.int32)), row.take(pa.array(whose)), *(pa.nulls(m, k) for k in kinds[2:8]), rare, pa.array(times.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(tail, heads)
            first += n
            del words, named, codes, doc, place, at, own, pairs, rare, whose, columns, tail
            free_memory()

    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("binary"), held_out(key).alias("held_out")).mapInArrow(look_up, shape)


def score_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", scores: str = "rank", rounds: int = ROUNDS) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document, after learning from the training ones."""
    spark = docs.sparkSession
    with scratch(spark) as folder:
        counted = written(word_counts(docs, key, text), "words", folder)
        documents = docs.where(~held_out(key)).count()
        totals = counted.agg(F.sum("trained").alias("n"), F.count_if(F.col("trained") > 0).alias("v")).first()
        tokens, types = (totals["n"] or 0) + documents, totals["v"] + (documents > 0)
        weights = fit_weights(counted, documents, path, scores, rounds)
        words = written(lexicon(counted, weights, path, scores), "lexicon", folder)
        placed = written(_looked_up(docs, words, key, text), "words-of-documents")
        rare = placed.where("word IS NOT NULL").select("pid", "row", "word", "times").join(small(words.select("word", "trained", "log10_p")), "word")
        sums = rare.groupBy("pid", "row").agg(
            F.sum(F.when(F.col("trained") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
            F.sum(F.col("times") * F.log10(F.col("trained") + 1.0)).alias("rare_base"),
            F.sum(F.col("times") * F.col("log10_p")).alias("rare_lattice"),
        )
        sums = written(sums, "rare-words")
    every = placed.where("word IS NULL").join(small(sums), ["pid", "row"], "left")
    or_none = lambda c: F.coalesce(F.col(c), F.lit(0))
    base = F.col("base") + or_none("rare_base") + F.lit(math.log10(documents + 1)) - F.col("n_tokens") * F.lit(math.log10(tokens + types + 1))
    return every.select(
        F.col("doc_id").alias(key), "held_out", "n_tokens", (F.col("known") + or_none("rare_known") + F.lit(int(documents > 0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("lattice") + or_none("rare_lattice") + F.lit(float(weights[0]) / math.log(10))).alias("score"),
    )
