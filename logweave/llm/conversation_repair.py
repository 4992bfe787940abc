"""Conversation structure repair over a suffix-shared automaton.

The rows of a conversation, taken by turn, become a signature of one letter for each row: the initial of its role (``s u a``,
``o`` for any other; a capital if the text is truncated), or ``X`` where the row must go (blank or seen before).  Conversations
with one signature have one solution, so signatures are made distinct, read from the end and sorted: signatures that share a
suffix then stand together, and the automaton built over them holds a node for each suffix.  A node keeps, for each state of the
grammar ``(s?(ua)+)?``, the cost to go and the first edit of the best audit suffix; later signatures with the same suffix
use it again.  Nodes whose costs to go differ by a constant share the step to their predecessors.  From a node and state, edits
that begin with different letters are all there are, so the cheapest cost and then the least first letter give the least audit.

Rows that agree in key, turn, role and text are counted before anything is shuffled.  Rows are sorted by ranges of key and turn, so a
conversation of any length spreads over many tasks; each batch writes one fragment of each signature it meets, a byte for
each row, and no task gathers the texts of a conversation.

Defined results: a null role or text is one space (so blank, if the text), null turns come first, rows of one turn stand in the
order of a digest of role and text, equal rows next to each other; rows of a null key are one conversation; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.plans.session import ship_package, shared_folder, small, written

#: States of the grammar, by what stands last: nothing, the system turn, a user turn, an assistant turn.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: The state behind the next speaker, for each state; the user speaks next in all but one.
_SPEAKS = (_USER, _USER, _ASSISTANT, _USER)
_LETTER = "uuau"
_NEVER = 1 << 40
#: Fixed costs of edits.
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 1, 2, 5, 5
#: White space, as one string for trimming.
_WHITE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Repaired:
    """``audits``: ``c`` (the key), ``n_rows``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``edits``, ``audit``, one row
    for each conversation; ``rows``: ``c, position, place, role, text`` of the repaired conversations, in that order."""

    audits: DataFrame
    rows: DataFrame


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` damaged by the crc32 of ``conv_id:turn``, modulo 20: 0 drops a row, 1 empties its text, 2 takes
    the ends of its sentences, 3 repeats it, 4 makes it the user's. A null is one space, but for ids and turns of the result."""
    held = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", held("conv_id"), held("turn"))) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(held("text"), "[.!?]", "")).otherwise(held("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(held("role"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_")).drop("_")


@lru_cache(maxsize=100_000)
def _step(symbol: str, after: tuple[int, ...]) -> tuple[int, tuple[int, ...], str]:
    """A node from the one behind it: the least cost to go, what each state's is above it, and each state's first edit.

    Edits: D deletes, K keeps, S keeps the system turn, U and A change the role, u and a insert a turn before.
    """
    extra = LEFT_TRUNCATED if symbol.isupper() else 0
    best = []
    for q, (to, letter) in enumerate(zip(_SPEAKS, _LETTER, strict=True)):
        tries = [(DELETE + after[q], "D", "D")]
        if symbol != "X":
            if symbol.lower() == letter:
                tries.append((extra + after[to], "K", "K"))
            elif symbol.lower() == "s" and q == _START:
                tries.append((extra + after[_SYSTEM], "K", "S"))
            tries.append((REROLE + extra + after[to], "R", letter.upper()))
        best.append(min(tries))
    return _inserting(best)


def _inserting(best: list[tuple[int, str, str]]) -> tuple[int, tuple[int, ...], str]:
    """Let each state insert the next speaker first, where that is cheaper, or as cheap and the lesser letter."""
    out = list(best)
    for q in (_ASSISTANT, _USER, _START, _SYSTEM):
        behind = best[_SPEAKS[q]] if q in (_USER, _ASSISTANT) else out[_SPEAKS[q]]
        out[q] = min(best[q], (INSERT + behind[0], "I", _LETTER[q]))
    least = min(x[0] for x in out)
    return least, tuple(min(x[0] - least, _NEVER) for x in out), "".join(x[2] for x in out)


#: The node behind the last row: ``.`` ends; after a system or user turn something must be inserted.
_END = _inserting([(0, "", "."), (_NEVER, "", "."), (_NEVER, "", "."), (0, "", ".")])


class SuffixAutomaton:
    """Nodes of the signature read last, by the length of their suffix; a new one keeps those of the suffix it shares."""

    def __init__(self) -> None:
        self.read = ""
        self.totals, self.above, self.first = [_END[0]], [_END[1]], [_END[2]]
        self.made = 0

    def solve(self, backwards: str) -> tuple[int, str]:
        """Cost and edits of a signature that is given from its end."""
        shared, most = 0, min(len(self.read), len(backwards))
        if self.read[:most] == backwards[:most]:
            shared = most
        else:
            while self.read[shared] == backwards[shared]:
                shared += 1
        for held in (self.totals, self.above, self.first):
            del held[shared + 1 :]
        for symbol in backwards[shared:]:
            least, above, first = _step(symbol, self.above[-1])
            self.totals.append(self.totals[-1] + least)
            self.above.append(above)
            self.first.append(first)
            self.made += 1
        self.read = backwards
        return self.totals[-1] + self.above[-1][_START], self._walk()

    def _walk(self) -> str:
        out, q = [], _START
        for first in reversed(self.first):
            while first[q] in "ua":
                out.append(first[q])
                q = _SPEAKS[q]
            edit = first[q]
            if edit == ".":
                break
            out.append("K" if edit == "S" else edit)
            if edit != "D":
                q = _SYSTEM if edit == "S" else _SPEAKS[q]
        return "".join(out)


def solved_signatures(signatures: DataFrame) -> DataFrame:
    """``signature, cost, edits`` of each different ``signature``; tasks get those with near suffixes, sorted by them."""
    ship_package(signatures.sparkSession)

    def solve(batches):
        automaton = SuffixAutomaton()
        for batch in batches:
            found = [automaton.solve(x) for x in batch.column(0).to_pylist()]
            names = [x[::-1] for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], ["signature", "cost", "edits"])

    backwards = signatures.select("signature").distinct().select(F.reverse("signature").alias("backwards"))
    dealt = backwards.repartitionByRange(F.substring("backwards", 1, 64)).sortWithinPartitions("backwards")
    return dealt.mapInArrow(solve, "signature string, cost long, edits string")


_LEGAL = {"su", "ua", "au"}
_FRAGMENT = "run string, n long, first string, last string, head long, tail long, low long, turns long, illegal long, blank long, duplicate long, truncated long"


class _Fragment:
    """The part of a conversation that one batch holds."""

    def __init__(self, turn, initial) -> None:
        self.run, self.n, self.head, self.low, self.turns, self.illegal = [], 0, turn, None, 0, 0
        self.counts = {"B": 0, "X": 0, "T": 0}
        self.first, self.last, self.tail = initial, None, None

    def add(self, turn, initial: str, symbol: str, n: int) -> None:
        self.illegal += (n - 1) * (2 * initial not in _LEGAL) + (self.n > 0 and self.last + initial not in _LEGAL)
        if turn is not None:
            self.turns += self.low is None or turn != self.tail
            self.low = turn if self.low is None else self.low
        if symbol in "BX":
            self.counts[symbol] += n
            self.run.append("X" * n)
        else:
            self.counts["X"] += n - 1
            self.counts["T"] += symbol.isupper()
            self.run.append(symbol + "X" * (n - 1))
        self.n, self.last, self.tail = self.n + n, initial, turn

    def row(self) -> tuple:
        return ("".join(self.run), self.n, self.first, self.last, self.head, self.tail, self.low, self.turns, self.illegal, *self.counts.values())


def _placed(ordered: DataFrame) -> DataFrame:
    """Fragments of signatures (``run`` is set), and the places in them of the rows that may stay (``digest`` is set)."""
    shape = f"c {dict(ordered.dtypes)['c']}, digest binary, turn long, pid int, no int, at long, {_FRAGMENT}"

    def cut(batches):
        pid, no = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows, own, before = [], None, None
            for c, turn, digest, initial, symbol, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if own is None or c != before:
                    if own:
                        rows.append((before, None, None, pid, no, None, *own.row()))
                    own, before, no = _Fragment(turn, initial), c, no + 1
                if symbol not in "BX":
                    rows.append((c, digest, turn, pid, no, own.n, *[None] * 12))
                own.add(turn, initial, symbol, n)
            if own:
                rows.append((before, None, None, pid, no, None, *own.row()))
            kinds = [batch.schema.field(0).type, pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.int64() if x.endswith("long") else pa.string() for x in _FRAGMENT.split(", ")]]
            names = ["c", "digest", "turn", "pid", "no", "at", *[x.split()[0] for x in _FRAGMENT.split(", ")]]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names)

    return ordered.repartitionByRange("c", "turn", "digest").sortWithinPartitions("c", "turn", "digest").mapInArrow(cut, shape)


def _rows(conversations: DataFrame, key: str) -> DataFrame:
    """Different rows with how often they stand there, and a digest of role and text."""
    held = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = conversations.select(F.col(key).alias("c"), F.col("turn").cast("long").alias("turn"), held("role").alias("role"), held("text").alias("text"))
    digest = F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256))
    return plain.groupBy("c", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("digest", digest)


def repair(conversations: DataFrame, key: str = "conv_id") -> Repaired:
    """The cheapest edits that give every conversation (``key, turn, role, text``) roles of the grammar, and what they leave."""
    ship_package(conversations.sparkSession)
    folder = shared_folder(conversations.sparkSession)
    rows = written(_rows(conversations, key), "turns", folder)
    bare = F.rtrim("text", F.lit(_WHITE))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    some = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    firsts = rows.groupBy("c", "digest").agg(F.min(some).alias("first")).select(F.col("c").alias("fc"), F.col("digest").alias("fd"), "first")
    faults = rows.select("c", "turn", "digest", initial.alias("initial"), letter.alias("letter"), "n", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open"))
    symbol = F.when(F.col("blank"), "B").when(~F.col("turn").eqNullSafe(F.col("first.turn")), "X").when(F.col("open"), F.upper("letter")).otherwise(F.col("letter"))
    marked = faults.join(firsts, F.col("c").eqNullSafe(F.col("fc")) & (F.col("digest") == F.col("fd"))).select("c", "turn", "digest", "initial", symbol.alias("symbol"), "n")
    placed = written(_placed(marked), "turn-places", folder)

    along = Window.partitionBy("c").orderBy("pid", "no")
    ended, spoke = F.lag("tail").over(along), F.lag("last").over(along)
    fragments = placed.where("run IS NOT NULL").withColumns({
        "offset": F.sum("n").over(along) - F.col("n"),
        "again": (F.col("head") == ended).cast("long"),
        "wrong": (~F.concat(spoke, F.col("first")).isin(*sorted(_LEGAL))).cast("long"),
    })
    fragments = written(fragments.select("c", "pid", "no", "offset", "again", "wrong", *[x.split()[0] for x in _FRAGMENT.split(", ")]), "turn-fragments", folder)
    nothing = F.lit(0).cast("long")
    gaps = F.max("tail") - F.min("low") + 1 - (F.sum("turns") - F.coalesce(F.sum("again"), nothing))
    runs = F.array_sort(F.collect_list(F.struct("offset", "run")))
    signed = fragments.groupBy("c").agg(
        F.sum("n").alias("n_rows"), F.coalesce(gaps, nothing).alias("gaps"), F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"),
        (F.sum("illegal") + F.coalesce(F.sum("wrong"), nothing)).alias("illegal"), F.array_join(F.transform(runs, lambda x: x["run"]), "").alias("signature"),
    )
    signed = written(signed, "signatures", folder)
    solved = written(solved_signatures(signed), "solved", folder)
    audits = signed.join(small(solved), "signature").withColumn("audit", F.translate("edits", "UAua", "RRII")).drop("signature")
    return Repaired(audits, _repaired_rows(audits, rows, placed, fragments))


def _repaired_rows(audits: DataFrame, rows: DataFrame, placed: DataFrame, fragments: DataFrame) -> DataFrame:
    """The edits of each row, with what is inserted before it, meet the row at its place in the conversation."""
    pieces = audits.select(F.col("c").alias("k"), F.posexplode(F.expr("regexp_extract_all(edits, '[ua]*[KDUA]|[ua]+', 0)")).alias("position", "piece")).where("piece <> 'D'")
    offsets = fragments.select(F.col("c").alias("oc"), F.col("pid").alias("op"), F.col("no").alias("on"), "offset")
    places = placed.where("digest IS NOT NULL").join(small(offsets), F.col("c").eqNullSafe(F.col("oc")) & (F.col("pid") == F.col("op")) & (F.col("no") == F.col("on")))
    places = places.select(F.col("c").alias("pc"), F.col("turn").alias("pt"), F.col("digest").alias("pd"), (F.col("offset") + F.col("at")).alias("at"))
    texts = rows.join(places, F.col("c").eqNullSafe(F.col("pc")) & F.col("turn").eqNullSafe(F.col("pt")) & (F.col("digest") == F.col("pd"))).select("c", "at", "role", "text")
    met = pieces.join(texts, F.col("k").eqNullSafe(F.col("c")) & (F.col("position") == F.col("at")), "left")
    last = F.right("piece", F.lit(1))
    kept = F.when(last == "K", F.col("role")).when(last == "U", F.lit("user")).when(last == "A", F.lit("assistant"))
    inserted = F.transform(F.expr("regexp_extract_all(piece, '[ua]', 0)"), lambda x: F.struct(F.when(x == "u", F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit("").alias("text")))
    every = F.concat(inserted, F.when(kept.isNotNull(), F.array(F.struct(kept.alias("role"), F.col("text").alias("text")))).otherwise(F.array().cast("array<struct<role:string,text:string>>")))
    return met.select(F.col("k").alias("c"), F.col("position").cast("long").alias("position"), F.posexplode(every).alias("place", "row")).select("c", "position", "place", "row.role", "row.text")


def joined_sha256(rows: DataFrame) -> DataFrame:
    """``c, sha256`` of the ``role:text`` lines of each conversation, joined by line feeds.

    A digest reads its lines one after another, so the lines of one conversation stream through one task, which holds a batch at most.
    """
    shape = f"c {dict(rows.dtypes)['c']}, sha256 string"

    def digest(batches):
        own, before, kind = None, None, None
        for batch in batches:
            kind, keys, found = batch.schema.field(0).type, [], []
            for c, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own is None or c != before:
                    if own:
                        keys.append(before)
                        found.append(own.hexdigest())
                    own, before = hashlib.sha256(), c
                else:
                    own.update(b"\n")
                own.update(line)
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(found, pa.string())], ["c", "sha256"])
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([before], kind), pa.array([own.hexdigest()], pa.string())], ["c", "sha256"])

    line = F.concat_ws(":", "role", "text").cast("binary").alias("line")
    ordered = rows.repartition("c").sortWithinPartitions("c", "position", "place")
    return ordered.select("c", line).mapInArrow(digest, shape)
