"""SentencePiece ids by streaming Viterbi, and back.

The best path is built in one pass over the characters. Only the characters since the last committed boundary
are kept: when no piece that began earlier reaches past a place, every surviving path goes through it;
otherwise, once the window holds a few times the longest piece, the backpointers of all open ends are followed
back to the last boundary they share. Ids up to there are committed and the window is cut.

A vocabulary of probabilities scores a path by the sum of its pieces' scores. In a vocabulary of merges scores
are ranks, and summing them gives other ids than merging does; there a path scores 0 if merging leaves each
two neighbours of it as they are, and minus infinity otherwise. Just one path to each place has score 0: that
is the segmentation by merges, found without ever merging a whole word.

No piece of a usual vocabulary goes on past a word's end, so paths converge between words; the ids between two
such places are the same wherever their characters come again, and are remembered while they are in use. Short
runs that are new in a slice of texts are segmented side by side, each in a window of its own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hapdiff.llm.wordhash import mix, slices

#: What stands for a blank in a vocabulary.
BLANK = "▁"
#: Bytes of text that are segmented together.
SLICE = 1 << 20
#: Bytes of runs that a Python worker remembers: those used lately and those before them, half each.
REMEMBERED_BYTES = 64 << 20
#: Neighbours whose merging is remembered.
REMEMBERED_PAIRS = 1 << 17
#: Longer runs are not remembered, and are fed to a window in portions of PORTION characters.
SHORT = 64
PORTION = 4096
#: Runs that are looked up together, and those of them that are segmented side by side.
TOGETHER, ABREAST = 1 << 16, 1 << 13
#: The key of a character c that has no piece is NO_PIECE + its code point.
NO_PIECE = 1 << 24


class Vocabulary:
    """Pieces with scores, and the 256 byte pieces that spell characters without a piece."""

    def __init__(self, pieces: list[tuple[str, float, int]], byte_ids: list[int], merges: bool = False):
        """pieces: text, score, id of each ordinary piece; byte_ids: the piece of each byte; merges: scores are ranks of merges."""
        self.byte_ids, self.merges = byte_ids, merges
        #: The id of each piece, and -1 for what only begins one.
        self.ids: dict[str, int] = {}
        for text, _, k in pieces:
            for n in range(1, len(text)):
                self.ids.setdefault(text[:n], -1)
            self.ids[text] = k
        self.scores = {k: score for _, score, k in pieces}
        self.spelled = {k: text for text, _, k in pieces}
        self.longest = max((len(p[0]) for p in pieces), default=1)
        self.unknown = min((p[1] for p in pieces), default=0.0) - 10.0  # the library's penalty
        inner = {c for text, _, _ in pieces if len(text) > 1 for c in text}
        alone = "".join(re.escape(c) for c in "\n\t\r\x0b\x0c" if c not in inner)
        self.converges = all(BLANK not in text.lstrip(BLANK) for text, _, _ in pieces)
        rest = f"{BLANK}*[^{BLANK}{alone}]+|{BLANK}+"
        self.runs = re.compile(f"[{alone}]|{rest}" if alone else rest)
        #: What stays() found for pairs.
        self.known: dict[int, bool] = {}

    @classmethod
    def load(cls, model: bytes) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        ordinary = [
            (sp.id_to_piece(k), sp.get_score(k), k)
            for k in range(sp.get_piece_size())
            if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k))
        ]
        return cls(ordinary, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], _is_merges(model))

    def texts(self) -> dict[int, bytes]:
        """What each id stands for in a text."""
        return {k: t.replace(BLANK, " ").encode() for k, t in self.spelled.items()} | {k: bytes([b]) for b, k in enumerate(self.byte_ids)}

    def _text(self, key: int) -> str:
        return chr(key - NO_PIECE) if key >= NO_PIECE else self.spelled[key]

    def merged(self, text: str) -> list[str]:
        """text after all merges: the best-ranked first, of equal ones the leftmost. For short texts."""
        parts = list(text)
        while True:
            best, at = None, -1
            for n in range(len(parts) - 1):
                k = self.ids.get(parts[n] + parts[n + 1], -1)
                if k >= 0 and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], n
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stays(self, left: int | None, right: int) -> bool:
        """Merging leaves the piece right as it is, and left before it (None: it begins the run)."""
        key = right if left is None else (left + 1) << 26 | right
        found = self.known.get(key)
        if found is None:
            a, b = "" if left is None else self._text(left), self._text(right)
            if a and self.ids.get(a + b, -1) >= 0:
                return False  # they are merged themselves
            found = self.merged(a + b) == ([a, b] if a else [b])
            if len(self.known) >= REMEMBERED_PAIRS:
                self.known.clear()
            self.known[key] = found
        return found


def _is_merges(model: bytes) -> bool:
    """Whether a vocabulary file says that it was made by merges: field 3 of the message in field 2 is 2."""

    def number(raw: bytes, i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            out |= (raw[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if raw[i - 1] < 128:
                return out, i

    def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
        i = 0
        while i < len(raw):
            tag, i = number(raw, i)
            if tag & 7 == 0:
                value, i = number(raw, i)
            else:
                size, i = (4, i) if tag & 7 == 5 else (8, i) if tag & 7 == 1 else number(raw, i)
                value, i = raw[i : i + size], i + size
            yield tag >> 3, value

    return any(own == 3 and value == 2 for field, trained in fields(model) if field == 2 for own, value in fields(trained))


class Stream:
    """The Viterbi window over characters that are fed in any portions."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.window = ""
        self.done = 0  # places of the window that were extended
        self.best: list = [0.0]
        self.back: list = [None]
        self.before: int | None = None  # the last committed piece
        self.most_kept = 0

    def feed(self, text: str, last: bool = False) -> list[int]:
        """The ids that text makes certain; last: no more text comes."""
        self.window += text
        v, out, most = self.v, [], self.v.longest
        ids, scores, merges, known = v.ids, v.scores, v.merges, v.known
        window, best, back = self.window, self.best, self.back
        n, i, base, far = len(window), self.done, 0, max(len(self.back) - 1, self.done)
        limit = 4 * most
        if not merges:
            best += [None] * (n + 1 - len(best))
        back += [None] * (n + 1 - len(back))
        while i < n and (last or i + most <= n):
            if i > base and (far <= i or i - base >= limit):
                to = i if far <= i else self._shared(i, far, base)
                if to > base:
                    self._commit(base, to, out)
                    base = to
                elif far > i:
                    limit = i - base + most
            if i > base:
                way = back[i]
                if way is None:  # no path ends here
                    i += 1
                    continue
                before = way[1]
            else:
                before = self.before
            alone, j = False, i
            pair = 0 if before is None else (before + 1) << 26  # the part of a pair's key, as in stays()
            while j < n:
                j += 1
                k = ids.get(window[i:j])
                if k is None:
                    break
                if k < 0:
                    continue
                alone = alone or j == i + 1
                if merges:
                    if back[j] is None:
                        good = known.get(pair | k)
                        if v.stays(before, k) if good is None else good:
                            back[j] = (i, k)
                            far = max(far, j)
                    continue
                total, old = best[i] + scores[k], best[j]
                if old is None or total > old:
                    best[j], back[j] = total, (i, k)
                far = max(far, j)
            if not alone:
                total, old = (0.0, None) if merges else (best[i] + v.unknown, best[i + 1])
                if back[i + 1] is None or not merges and total > old:
                    back[i + 1] = (i, NO_PIECE + ord(window[i]))
                    if not merges:
                        best[i + 1] = total
                far = max(far, i + 1)
            i += 1
        if last:
            self._commit(base, n, out)
            self.most_kept = max(self.most_kept, n - base)
            self.window, self.done, self.best, self.back, self.before = "", 0, [0.0], [None], None
            return out
        self.most_kept = max(self.most_kept, n - base)
        self.window, self.done = window[base:], i - base
        self.best = best[base : max(far, i) + 1] if not merges else [0.0]
        self.back = [x and (x[0] - base, x[1]) for x in back[base : max(far, i) + 1]]
        self.back[0] = None
        return out

    def _shared(self, i: int, far: int, base: int) -> int:
        """The last boundary before or at i that the paths to all open ends share."""
        ends = {e for e in range(i, far + 1) if self.back[e] is not None}
        while len(ends) > 1:
            top = max(ends)
            ends.discard(top)
            ends.add(self.back[top][0])
            if min(ends) <= base:
                return base
        return ends.pop()

    def _commit(self, base: int, to: int, out: list[int]) -> None:
        own: list[int] = []
        at = to
        if to > base:
            self.before = self.back[to][1]
        while at > base:
            at, k = self.back[at]
            own.extend(reversed([self.v.byte_ids[b] for b in _spelled(chr(k - NO_PIECE))]) if k >= NO_PIECE else (k,))
        out.extend(reversed(own))


#: A text's own U+2581 is no blank: it travels as this private character and is spelled in bytes.
_OWN = "\U0010fffd"


def _spelled(c: str) -> bytes:
    return (BLANK if c == _OWN else c).encode()


class Pairs:
    """What Vocabulary.stays() found for pairs, in a table that arrays of pairs are looked up in at once."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.bits = (4 * REMEMBERED_PAIRS - 1).bit_length()
        self._clear()

    def _clear(self) -> None:
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.good = np.zeros(1 << self.bits, bool)
        self.held = 0

    def _slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key the slot that holds it or the free one where it belongs, and whether it is held."""
        slot = (mix(keys.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.keys[slot] == keys
        open_ = np.flatnonzero(~found & (self.keys[slot] != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[open_]]
            found[open_] = there == keys[open_]
            open_ = open_[(there != -1) & (there != keys[open_])]
        return slot, found

    def stay(self, before: np.ndarray, k: np.ndarray) -> np.ndarray:
        """stays(before, k) of each; before is -1 where a run begins."""
        keys = (before.astype(np.int64) + 1) << 26 | k
        slot, found = self._slots(keys)
        if found.all():
            return self.good[slot]
        new, at = np.unique(keys[~found], return_inverse=True)
        values = np.fromiter((self.v.stays((x >> 26) - 1 if x >> 26 else None, x & ((1 << 26) - 1)) for x in new.tolist()), bool, len(new))
        good = self.good[slot]
        good[~found] = values[at]
        if self.held + len(new) > 2 * REMEMBERED_PAIRS:
            self._clear()
        new, values = new[:REMEMBERED_PAIRS], values[:REMEMBERED_PAIRS]
        self.held += len(new)
        while len(new):
            free, first = np.unique(self._slots(new)[0], return_index=True)
            self.keys[free], self.good[free] = new[first], values[first]
            new, values = np.delete(new, first), np.delete(values, first)
        return good


class Abreast:
    """The Viterbi window over many short runs at once, each whole in its window: place by place, all runs together."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.pairs = vocabulary, Pairs(vocabulary)
        chars = sorted(t for t in vocabulary.ids if len(t) == 1 and vocabulary.ids[t] >= 0)
        # the table's characters: up to 255 that begin most pieces; runs of others take the other way
        often = Counter(c for t in vocabulary.spelled.values() for c in t)
        chars = sorted(chars, key=lambda c: (-often[c], c))[:255]
        self.code = np.zeros(1 << 16, np.uint8)
        for k, c in enumerate(chars, 1):
            if ord(c) < 1 << 16:
                self.code[ord(c)] = k
        place = {c: int(self.code[ord(c)]) for c in chars if ord(c) < 1 << 16}
        texts = [t for t in vocabulary.ids if all(c in place for c in t)]
        inner = sorted({t[:-1] for t in texts} | {""}, key=lambda t: (len(t), t))
        leaves = sorted(set(texts) - set(inner))
        node = {t: k for k, t in enumerate(inner + leaves)}
        self.inner = len(inner)
        self.child = np.zeros((len(inner), 256), np.uint16 if len(node) < 1 << 16 else np.int32)
        self.piece = np.full(len(node), -1, np.int32)
        for t in texts:
            self.child[node[t[:-1]], place[t[-1]]] = node[t]
            self.piece[node[t]] = vocabulary.ids[t]
        self.score = np.zeros(max(vocabulary.scores, default=0) + 1)
        for k, x in vocabulary.scores.items():
            self.score[k] = x

    def solve(self, runs: list[str]) -> tuple[list[str], list[bytes], list[str]]:
        """Runs whose characters are all in the table with their ids, four bytes each, and the others."""
        units = np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, runs), np.int64, len(runs))
        code = np.where(units < 1 << 16, self.code[np.minimum(units, (1 << 16) - 1)], 0)
        fits = np.minimum.reduceat(code, np.cumsum(size) - size) > 0
        other = [runs[k] for k in np.flatnonzero(~fits)]
        order = np.flatnonzero(fits)[np.argsort(-size[fits], kind="stable")]
        if not len(order):
            return [], [], other
        starts, size = (np.cumsum(size) - size)[order], size[order]
        longest = int(size[0])
        column = np.arange(longest + self.v.longest + 1)
        window = np.where(column < size[:, None], code[np.minimum(starts[:, None] + column, len(code) - 1)], 0).astype(np.uint8)
        back = np.full((len(order), longest + 1), -1, np.int32)
        step = np.zeros((len(order), longest + 1), np.uint8)
        best = None if self.v.merges else np.full((len(order), longest + 1), -np.inf)
        if best is not None:
            best[:, 0] = 0.0
        for i in range(longest):
            rows = np.arange(int(np.searchsorted(-size, -i, "left")))  # the runs that are longer than i
            node, d = self.child[0, window[rows, i]], 1
            while len(rows):
                k = self.piece[node]
                if best is None:
                    some = np.flatnonzero((k >= 0) & (back[rows, i + d] < 0))
                    r, k = rows[some], k[some]
                    good = self.pairs.stay(back[r, i] if i else np.full(len(r), -1, np.int32), k)
                else:
                    some = np.flatnonzero(k >= 0)
                    r, k = rows[some], k[some]
                    total = best[r, i] + self.score[k]
                    good = total > best[r, i + d]
                    best[r[good], i + d] = total[good]
                back[r[good], i + d], step[r[good], i + d] = k[good], d
                d += 1
                on = np.flatnonzero(node < self.inner)
                node = self.child[node[on], window[rows[on], i + d - 1]]
                alive = np.flatnonzero(node)
                rows, node = rows[on[alive]], node[alive]
        at, rows, backwards = size.copy(), np.arange(len(order)), []
        count = np.zeros(len(order), np.int64)
        while len(rows):
            backwards.append((rows, back[rows, at[rows]]))
            count[rows] += 1
            at[rows] -= step[rows, at[rows]]
            rows = rows[at[rows] > 0]
        ends = np.cumsum(count)
        flat = np.zeros(int(ends[-1]), np.int32)
        for n, (rows, k) in enumerate(backwards, 1):
            flat[ends[rows] - n] = k
        raw = flat.tobytes()
        return [runs[k] for k in order], [raw[4 * a : 4 * b] for a, b in zip((ends - count).tolist(), ends.tolist(), strict=True)], other


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        # runs to their ids, four bytes each
        self.lately: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        self.held = 0  # bytes of lately, about
        self.stream, self.abreast = Stream(vocabulary), Abreast(vocabulary)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text: a blank before it and U+2581 for blanks, as the vocabulary has it. Nothing for null or empty."""
        marked = [BLANK + t.replace(BLANK, _OWN).replace(" ", BLANK) if t else "" for t in texts]
        if not self.v.converges:
            return [np.array(self._streamed(s) if s else [], np.int32) for s in marked]
        split = [self.v.runs.findall(s) for s in marked]
        runs = [run for own in split for run in own]
        parts, sizes = [], []
        for at in range(0, len(runs), TOGETHER):
            own = runs[at : at + TOGETHER]
            long = self._look_up(own)
            found = [*map(self.lately.__getitem__, own)]
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)) // 4)
            parts.append(np.frombuffer(b"".join(found), np.int32))
            for run in long:
                del self.lately[run]
        ends = np.cumsum(np.concatenate([[0], *sizes]))[np.cumsum([0, *map(len, split)])]
        return np.split(np.concatenate([np.zeros(0, np.int32), *parts]), ends[1:-1])

    def _streamed(self, s: str) -> list[int]:
        out = []
        for at in range(0, len(s), PORTION):
            out += self.stream.feed(s[at : at + PORTION], last=at + PORTION >= len(s))
        return out

    def _look_up(self, runs: list[str]) -> list[str]:
        """Puts the ids of all runs into lately; the long ones, which are not to stay there, are returned."""
        if self.held >= REMEMBERED_BYTES // 2:
            self.lately, self.earlier, self.held = {}, self.lately, 0
        new = set(runs) - self.lately.keys()
        again = new & self.earlier.keys()
        for run in again:
            self._remember(run, self.earlier[run])
        new -= again
        short, long = [run for run in new if len(run) <= SHORT], [run for run in new if len(run) > SHORT]
        for at in range(0, len(short), ABREAST):
            solved, ids, other = self.abreast.solve(short[at : at + ABREAST])
            for run, own in zip(solved, ids, strict=True):
                self._remember(run, own)
            for run in other:
                self._remember(run, np.array(self.stream.feed(run, last=True), np.int32).tobytes())
        for run in long:
            self.lately[run] = np.array(self._streamed(run), np.int32).tobytes()
        return long

    def _remember(self, run: str, ids: bytes) -> None:
        self.lately[run] = ids
        self.held += 240 + 2 * len(run) + len(ids)


@lru_cache(maxsize=2)
def _codec(model: bytes) -> Codec:
    """One for each Python worker and vocabulary, so that later batches find what earlier ones remembered."""
    return Codec(Vocabulary.load(model))


def read_model(spark: SparkSession, path: str) -> bytes:
    """The vocabulary file: from the driver's disk, or through Spark where path is a URI. Tasks get its bytes."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs and ids_col, array<int>: the ids of each whole text. They are the library's, but that U+2581 in a text is spelled in
    bytes instead of being read as a blank, so that every text comes back whole.

    A column of the name ids_col is replaced; other columns stay, whatever their names. Null and empty texts have no ids, equal
    rows equal ones, an empty table none. A window is held where paths don't converge, such as over one word of a single letter
    without end; it is then as long as that word at most.
    """
    rest = docs.drop(ids_col).withColumn(text_col, F.col(text_col).cast("string"))
    names = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            for part in slices(batch, text_col, SLICE):
                found = codec.encode_all(part.column(text_col).to_pylist())
                ends = np.cumsum([0, *map(len, found)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*names, ids_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return rest.mapInArrow(run, f"{schema}, `{ids_col}` array<int>")


def decode(df: DataFrame, model: bytes, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df and text_col: the text that ids_col stands for (null or no ids: empty; ids that are no piece or byte, and null ones: nothing;
    bytes that are no UTF-8: U+FFFD). A column of that name is replaced. The pieces travel as one array in the expression."""
    texts = Vocabulary.load(model).texts()
    pieces = F.split(F.lit(",".join(texts.get(k, b"").hex() for k in range(max(texts) + 1))), ",")
    raw = F.array_join(F.transform(F.col(ids_col), lambda k: F.get(pieces, k)), "")
    text = F.make_valid_utf8(F.unhex(raw).cast("string"))
    return df.withColumn(text_col, F.coalesce(F.substr(text, F.lit(2)), F.lit("")))
