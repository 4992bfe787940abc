"""Token ids of texts from the public tokenizer libraries, with repeated pieces encoded once.

A text is cut at safe boundaries: before a space between two characters that are no white space, between a Latin letter
and a punctuation mark, and around a line feed that stands alone.  The pre-tokenisers whose files are known here (byte-level
and word patterns) always start a new pre-token there, so the ids of a text are the ids of its pieces in order.  Pieces
are told apart by Arrow's dictionary encoding, in batches of bounded bytes; a memory of bounded bytes keeps the ids of those
met before, and all others go to the library together.  Files with another pre-tokeniser, and sentencepiece models, get whole
texts.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from logweave.llm.text import free_memory

_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Stands at a cut while a batch is taken apart; texts that hold it themselves are not cut.
_CUT = "\x1f"
#: Latin letters, but for the one (I with a dot) whose small form ends in a mark, which joins the punctuation behind it; the signs
#: of multiplication and division (U+00D7, U+00F7) lie between them and are none.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
MARKS = ",.;:!?"
_LETTER_MARK = f"([{LETTERS}])([{MARKS}])"
_LONE_LINE_FEED = r"(\S)\n(\S)"
_CUTS = re.compile(f"[ \n{_CUT}]|{_LETTER_MARK}")
#: Patterns of the pre-tokenisers at which a single space starts a new pre-token.
_PATTERNS = {r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _separator(spec: dict) -> str | None:
    """What can stand between pieces without changing their ids, for files whose texts can be cut; it is one pre-token of its own."""
    norms = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
    for n in norms.get("normalizers", [norms]):
        if n["type"] not in ("NFC", "Lowercase") and not (n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " "):
            return None
    pre = spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    first = steps[0]
    if any(_CUTS.search(t["content"]) for t in spec.get("added_tokens", [])):
        return None
    if len(steps) == 1:
        plain = first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and bool(first.get("use_regex", True)) and not spec.get("normalizer")
        return "\n" if plain else None
    words = first.get("type") == "Split" and first["pattern"].get("Regex") in _PATTERNS and first["behavior"] == "Removed" and first["invert"]
    return " 7 " if words and all(s["type"] == "ByteLevel" and not s.get("add_prefix_space") and not s.get("use_regex", True) for s in steps[1:]) else None


class Encoder:
    """Ids (little-endian unsigned 32-bit) or counts of texts; one for each worker process and file."""

    #: Bytes of the texts that are taken apart together, of those the library gets at once, and of remembered pieces.
    BATCH_BYTES = 3_000_000
    LIBRARY_BYTES = 500_000
    MEMORY_BYTES = 24_000_000
    #: What one remembered piece takes beside its characters and ids.
    _ENTRY = 16

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.separator = None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.library = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_padding()
            tokenizer.no_truncation()
            self.library = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
            separator = _separator(json.loads(Path(path).read_text(encoding="utf-8")))
            ids = self.library([separator])[0] if separator else []
            if len(ids) == 1:
                self.separator, self.separator_id = separator, ids[0]
        self._forget()

    def _forget(self) -> None:
        """An empty memory: pieces, and for each where its ids stand in ``flat``, how many (-1: not safe), and batches that held it."""
        self.names = pa.array([], pa.string())
        self.flat = np.empty(0, dtype="<u4")
        self.start, self.size, self.seen = (np.empty(0, dtype=kind) for kind in (np.int64, np.int32, np.int32))

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        """Straight from the library, in batches balanced by bytes."""
        out: list[np.ndarray] = []
        batch: list[str] = []
        size = 0
        for text in texts:
            n = len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))
            if batch and size + n > self.LIBRARY_BYTES:
                out += [np.array(x, dtype="<u4") for x in self.library(batch)]
                batch, size = [], 0
            batch.append(text)
            size += n
        if batch:
            out += [np.array(x, dtype="<u4") for x in self.library(batch)]
        return out

    def _joined(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of safe pieces that hold no separator, and how many each has: joined by it, encoded as long texts, and cut where its id stands."""
        ids, sizes = [np.empty(0, dtype="<u4")], [np.empty(0, dtype=np.int64)]
        for first in range(0, len(pieces), 20_000):
            part = pieces.slice(first, 20_000)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), self.separator)
            own = np.array(self.library(text.to_pylist())[0], dtype="<u4")
            at = own == self.separator_id
            sizes.append(np.diff(np.flatnonzero(at), prepend=-1, append=len(own)) - 1)
            ids.append(own[~at])
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Remember new pieces; returns their places.

        Those that begin or end in white space, but for one space before, are not safe; a line feed alone is, and nothing
        is, as it stands before a text's first space only.
        """
        inner = pc.replace_substring_regex(new, "^ ", "")
        empty = _flags(pc.equal(new, ""))
        safe = _flags(pc.and_(pc.equal(pc.utf8_trim_whitespace(inner), inner), pc.not_equal(inner, ""))) | _flags(pc.equal(new, "\n"))
        odd = _flags(pc.match_substring(new, self.separator.strip(" ")))
        for t in self.added:
            odd |= _flags(pc.match_substring(new, t))
        plain, alone, rest = np.flatnonzero(safe & ~odd), np.flatnonzero(safe & odd), np.flatnonzero(~safe)
        ids, sizes = self._joined(new.take(pa.array(plain)))
        more = self._encode(new.take(pa.array(alone)).to_pylist())
        sizes = np.concatenate([sizes, np.array([len(x) for x in more], dtype=np.int64), empty[rest] - 1]).astype(np.int32)
        order, known, counts = np.concatenate([plain, alone, rest]), len(self.size), np.maximum(sizes, 0)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(counts, dtype=np.int64) - counts])
        self.flat = np.concatenate([self.flat, ids, *more])
        self.size, self.seen = np.concatenate([self.size, sizes]), np.concatenate([self.seen, np.zeros(len(new), dtype=np.int32)])
        self.names = pa.concat_arrays([self.names, new.take(pa.array(order))])
        places = np.empty(len(new), dtype=np.int64)
        places[order] = known + np.arange(len(new))
        return places

    def _make_room(self) -> None:
        """Pieces that one batch alone has held are forgotten; all, if what is left still takes most of the room."""
        keep = np.flatnonzero(self.seen > 1)
        size = self.size[keep]
        counts = np.maximum(size, 0)
        names, flat = self.names.take(pa.array(keep)), self.flat[ragged(self.start[keep], counts)]
        self._forget()
        if names.nbytes + flat.nbytes + self._ENTRY * len(names) <= self.MEMORY_BYTES // 2:
            self.names, self.flat, self.start, self.size = names, flat, np.cumsum(counts, dtype=np.int64) - counts, size
            self.seen = np.ones(len(size), dtype=np.int32)

    def _full(self) -> bool:
        return self.names.nbytes + self.flat.nbytes + self._ENTRY * len(self.size) > self.MEMORY_BYTES

    def _runs(self, texts: pa.Array):
        """Consecutive slices of about ``BATCH_BYTES``; a longer text stands alone."""
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        first = 0
        while first < len(texts):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + self.BATCH_BYTES, side="right")))
            yield texts.slice(first, last - first)
            first = last

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """Memory places of all pieces of the texts, where each text's pieces begin (and the end), and ids of texts that can't be cut."""
        marked = pc.replace_substring_regex(texts, _LETTER_MARK, f"\\1{_CUT}\\2")
        marked = pc.replace_substring_regex(marked, _LONE_LINE_FEED, f"\\1{_CUT}\n{_CUT}\\2")
        marked = pc.replace_substring(marked, " ", f"{_CUT} ")
        lists = pc.split_pattern(marked, _CUT)
        named = lists.flatten().dictionary_encode()
        held = pc.fill_null(pc.index_in(named.dictionary, value_set=self.names), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(held < 0)
        if len(new):
            held[new] = self._learn(named.dictionary.take(pa.array(new)))
        self.seen[held] += 1
        at = held[named.indices.to_numpy()]
        edges = lists.offsets.to_numpy().astype(np.int64)
        edges -= edges[0]
        bad = np.concatenate([[0], np.cumsum(self.size[at] < 0)])
        own = _flags(pc.match_substring(texts, _CUT))
        whole = {}
        for i in np.flatnonzero((bad[edges[1:]] > bad[edges[:-1]]) | own).tolist():
            head, *tail = _SAFE.split(texts[i].as_py())
            whole[i] = np.concatenate(self._encode([head, *(" " + x for x in tail)]))
        return at, edges, whole

    def _counted(self, at: np.ndarray, edges: np.ndarray, whole: dict[int, np.ndarray]) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(np.maximum(self.size[at], 0), dtype=np.int64)])
        counts = total[edges[1:]] - total[edges[:-1]]
        for i, ids in whole.items():
            counts[i] = len(ids)
        return counts

    def encoded(self, texts: pa.Array):
        """Yields ``(ids, ends)`` for consecutive runs of texts: all ids of the run, and where each text's end; null is an empty text."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        for run in self._runs(texts):
            if self.separator is None:
                parts = self._encode(run.to_pylist())
                yield np.concatenate(parts), np.cumsum([len(x) for x in parts], dtype=np.int64)
                continue
            at, edges, whole = self._cut(run)
            counts = self._counted(at, edges, whole)
            if whole:
                keep = np.ones(len(counts), dtype=bool)
                keep[list(whole)] = False
                at = at[np.repeat(keep, np.diff(edges))]
            ids = self.flat[ragged(self.start[at], self.size[at])]
            if whole:
                ends = np.cumsum(counts)
                filled = np.empty(int(ends[-1]), dtype="<u4")
                filled[np.repeat(keep, counts)] = ids
                for i, own in whole.items():
                    filled[ends[i] - len(own) : ends[i]] = own
                ids = filled
            yield ids, np.cumsum(counts)
            if self._full():
                self._make_room()
        free_memory()

    def ids(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """The ids of each text; null is an empty text."""
        out: list[bytes] = []
        for ids, ends in self.encoded(_strings(texts)):
            raw, last = ids.tobytes(), 0
            for end in ends.tolist():
                out.append(raw[4 * last : 4 * end])
                last = end
        return out

    def counts(self, texts: list[str | None] | pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        texts, out = pc.fill_null(_strings(texts).cast(pa.string()), ""), [np.empty(0, dtype=np.int64)]
        for run in self._runs(texts):
            out.append(np.array([len(x) for x in self._encode(run.to_pylist())], dtype=np.int64) if self.separator is None else self._counted(*self._cut(run)))
            if self._full():
                self._make_room()
        return np.concatenate(out)


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a run of texts and their ends, with ``end_id`` after each text."""
    return np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)


def binaries(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive runs of ids of these lengths as binary values, without copying them."""
    edges = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(4 * lengths, out=edges[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(ids, dtype="<u4"))])


def vocabulary_size(path: str) -> int:
    """One more than the largest id of a vocabulary file."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1


def _flags(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(bool)


def _strings(texts) -> pa.Array:
    return texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges of these starts and sizes, one after another."""
    ends = np.cumsum(size, dtype=np.int64)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a file."""
    return Encoder(path)
