"""Tokens of two tokenizers laid side by side: where they end together, which ids go together, and how often.

Documents are dealt into blocks. A text is cut before blanks behind which no token of either side reaches, and what lies between is
a piece: most are words, which a block's documents repeat, and each different one is aligned once. DuckDB holds the tokens of many
pieces as interval tables on one axis of bytes: a join of the ends gives the cuts, window sums number the groups between them, ASOF
joins find each cut's piece and each token's group, and a range join within groups finds overlaps. A block's counts of id pairs are
added up by Spark over all blocks and come back to the blocks that hold the pair.
"""

from __future__ import annotations

import functools
import itertools
import json
import operator
import re
import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hapdiff.llm.common import cut, deal, whole

BLOCK_BYTES = 4 << 20
#: Bytes of pieces whose tokens are in DuckDB at once, one piece at least.
SLICE_BYTES = 1 << 19
#: A blank behind white space, where a text isn't cut, and the places where it is.
NO_CUT, CUT = re.compile(r"\s "), re.compile(r"(?<=\S)(?= )")
#: Pieces whose ids are made, or whose bytes are looked at, together.
TOGETHER = 2048
#: A pair is in as many rows as there are blocks with it: so many of them meet in a task of the join with its count.
BLOCKS_EACH = 4096
#: The byte-level scheme's way of cutting texts, and the bytes that stand for themselves in its alphabet.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))
#: How a token of one side is linked with one of the other: by ranges that end together, or that share a byte.
LINKS = {
    "ends": "select a.id as a, b.id as b, a.e as e from a join b on a.e = b.e",
    "overlaps": """
        select a.id as a, b.id as b, greatest(a.s, b.s) + 1 as e from (select t.*, c.g from a t asof join cut c on t.e <= c.e) a
        join (select t.*, c.g from b t asof join cut c on t.e <= c.e) b on a.g = b.g and a.s < b.e and b.s < a.e""",
}


class ByteLevel:
    """Byte-level merges from a tokenizers JSON file; an entry's id is its rank. Strings of special tokens are plain text."""

    def __init__(self, file: bytes):
        own = json.loads(file)
        added = {t["id"] for t in own.get("added_tokens", [])}
        others = (b for b in range(256) if b not in PRINTABLE)
        byte = {chr(b): b for b in PRINTABLE} | {chr(256 + k): b for k, b in enumerate(others)}
        ranks = {bytes(byte[c] for c in entry): i for entry, i in own["model"]["vocab"].items() if i not in added}
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for entry, i in ranks.items():
            self.sizes[i] = len(entry)
        self.encoding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts: list[str]) -> list[list[int]]:
        """The ids of a blank and each text; they spell it whatever it is. No token has a blank behind another sign than white space."""
        return [self.encoding.encode_ordinary(" " + t) for t in texts]

    def flat(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and how many each has. Pieces that end without white space are encoded as one text, with
        blanks between them: no token reaches over those, so its ids are theirs."""
        ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(pieces), TOGETHER):
            own = pieces[at : at + TOGETHER]
            if "" in own or list(map(str.rstrip, own)) != own:
                got, n = _flat(self.ids(own))
            else:
                got = np.array(self.encoding.encode_ordinary(" " + " ".join(own)), np.int64)
                n = np.diff(np.searchsorted(np.cumsum(self.sizes[got]), _stops(own)) + 1, prepend=0)
            ids.append(got)
            counts.append(n)
        return np.concatenate(ids), np.concatenate(counts)


class Pieces:
    """A SentencePiece model, which puts the blank before a text itself."""

    def __init__(self, file: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.spelled = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = np.array(list(map(len, self.spelled)), np.int64)
        #: No piece has a blank behind another sign: ids of a text are those of its parts that begin with blanks.
        self.cuts = all("▁" not in p.lstrip("▁") for p in pieces)

    def ids(self, texts: list[str]) -> list[list[int] | None]:
        """The ids of a blank and each text, None where their bytes are others. The model drops the blanks of a text of blanks alone,
        but gives their ids behind a word."""
        before = len(self.model.encode("a"))
        own = self.model.encode([t if t.strip(" ") else f"a {t}" for t in texts], num_threads=1)
        own = [ids if t.strip(" ") else ids[before:] for t, ids in zip(texts, own, strict=True)]
        return [ids if b"".join(map(self.spelled.__getitem__, ids)) == (" " + t).encode() else None for t, ids in zip(texts, own, strict=True)]

    def flat(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and how many each has, -1 where its bytes are others. The bytes of many pieces are compared
        at once, and one by one only where those differ."""
        ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        encoded = self.model.encode(pieces, num_threads=1)
        for at in range(0, len(pieces), TOGETHER):
            own, each = pieces[at : at + TOGETHER], encoded[at : at + TOGETHER]
            got, n = _flat(each)
            same = n.all() and (np.cumsum(self.sizes[got])[np.cumsum(n) - 1] == _stops(own)).all()
            if not same or b"".join(map(self.spelled.__getitem__, itertools.chain.from_iterable(each))) != (" " + " ".join(own)).encode():
                got, n = _flat(self.ids(own))
            ids.append(got)
            counts.append(n)
        return np.concatenate(ids), np.concatenate(counts)


def _flat(ids: list[list[int] | None]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in a row, and how many each has; -1 for None."""
    own = [x or () for x in ids] if None in ids else ids
    n = np.array([-1 if x is None else len(x) for x in ids] if None in ids else list(map(len, ids)), np.int64)
    return np.array(list(itertools.chain.from_iterable(own)), np.int64), n


def _stops(pieces: list[str]) -> np.ndarray:
    """Where pieces end in bytes, each behind its blank."""
    return np.cumsum(np.array(list(map(len, map(str.encode, pieces))), np.int64) + 1)


@functools.lru_cache(2)
def _vocabularies(first: bytes, second: bytes) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(first), Pieces(second)


def cut_text(text: str) -> list[str]:
    """A text's pieces, each without the blank that it begins with (the first one's is put before the text)."""
    if NO_CUT.search(text) or text.startswith(" "):
        return [p[1:] for p in CUT.split(" " + text)]
    return text.split(" ")


class _Slice:
    """The tokens of some pieces in DuckDB: a and b (i, id, s, e) and d (k, n, e), on one axis of bytes."""

    def __init__(self, con: duckdb.DuckDBPyConnection, at: np.ndarray, counts: np.ndarray, tokens: list[tuple[np.ndarray, np.ndarray]], sides: tuple[ByteLevel, Pieces]):
        self.con, self.ids = con, []
        for name, (ids, _), side in zip("ab", tokens, sides, strict=True):
            ends = np.cumsum(side.sizes[ids])
            self.ids.append(ids)
            con.register(name, pa.table({"i": np.arange(len(ids)), "id": ids, "s": ends - side.sizes[ids], "e": ends}))
        last = np.cumsum(tokens[1][1]) - 1
        con.register("d", pa.table({"k": at, "n": counts, "e": ends[last]}))

    def group(self) -> None:
        """cut (e, g, k, last_a, last_b): the offsets where tokens of both sides end, numbered, with their piece and last tokens."""
        self.con.execute("""
            create or replace temp table cut as
            select c.*, d.k from (select a.e, sum(1) over (order by a.e)::bigint as g, a.i as last_a, b.i as last_b
                                  from (select e, max(i) as i from a group by e) a join (select e, max(i) as i from b group by e) b on a.e = b.e) c
            asof join d on c.e <= d.e""")

    def pairs(self, link: str) -> pa.Table:
        if link == "overlaps":
            self.group()
        return self.con.sql(f"select a::int as a, b::int as b, sum(d.n)::bigint as n from ({LINKS[link]}) l asof join d on l.e <= d.e group by all").to_arrow_table()

    def figures(self, link: str) -> pa.Table:
        """k, n_groups, n_links, n_best, count_sum of each piece; pair (a, b, total, best) holds the corpus's counts."""
        return self.con.sql(f"""
            with l as (select d.k, count(*) as n_links, count(p.total) as n_found, count(*) filter (p.best) as n_best, sum(p.total)::bigint as count_sum
                       from ({LINKS[link]}) l left join pair p using (a, b) asof join d on l.e <= d.e group by d.k)
            select k, n_groups, n_links, n_best, count_sum, n_found from (select k, count(*) as n_groups from cut group by k) g join l using (k)""").to_arrow_table()

    def texts(self) -> dict[int, str]:
        """Each piece's groups: ids of either side joined by commas, sides by a bar, groups by semicolons."""
        cuts = self.con.execute("select k, last_a, last_b from cut order by g").fetchnumpy()
        doc, ends = np.asarray(cuts["k"]), [np.asarray(cuts[c]) + 1 for c in ("last_a", "last_b")]
        n_a, n_b = (np.diff(e, prepend=0) for e in ends)
        total = ends[0] + ends[1]  # tokens of both sides up to a group's end
        codes = np.empty(int(total[-1]), np.int64)
        at_a = np.arange(len(self.ids[0])) + np.repeat(ends[1] - n_b, n_a)  # a group's tokens of one side, then of the other
        at_b = np.arange(len(self.ids[1])) + np.repeat(ends[0], n_b)
        codes[at_a], codes[at_b] = self.ids[0] * 3 + 2, self.ids[1] * 3 + 2
        codes[total - n_b - 1] -= 1
        codes[total - 1] -= 2
        spelled = _spelled(int(codes.max()) // 3)
        last = np.flatnonzero(np.r_[doc[1:] != doc[:-1], True])
        codes, out, at = codes.tolist(), {}, 0
        for k, end in zip(doc[last].tolist(), total[last].tolist(), strict=True):
            out[k] = "".join(map(spelled.__getitem__, codes[at:end]))[:-1]
            at = end
        return out


@functools.lru_cache(4)
def _spelled(most: int) -> list[str]:
    """Ids up to `most` with each of the signs that may follow."""
    return [f"{i}{sign}" for i in range(most + 1) for sign in ";|,"]


class _Block:
    """A block's documents as rows of numbers of different pieces: docs (None: no tokens), counts of the pieces, sizes in tokens."""

    def __init__(self, texts: list[str], sides: tuple[ByteLevel, Pieces]):
        self.sides, known = sides, {}
        cut_ = cut_text if sides[1].cuts else lambda t: [t]
        docs = [[known.setdefault(p, len(known)) for p in cut_(t)] if t else None for t in texts]
        # pieces that end in white space come last, where they are encoded one by one; without cuts pieces are texts
        words = list(known)
        late = np.array(list(map(operator.ne, words, map(str.rstrip, words))), bool)
        late[[known[""]] if "" in known else []] = True
        place = None
        if late.any():
            order = np.argsort(late, kind="stable")
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            words = list(map(words.__getitem__, order.tolist()))
        self.tokens = [side.flat(words) for side in sides]
        good = self.tokens[1][1] >= 0
        docs = [None if d is None else np.array(d, np.int64) for d in docs]
        if place is not None:
            docs = [None if d is None else place[d] for d in docs]
        self.docs = [d if d is not None and good[d].all() else None for d in docs]
        self.counts = np.zeros(len(words), np.int64)
        for d in self.docs:
            if d is not None:
                np.add.at(self.counts, d, 1)
        self.sizes = [np.maximum(n, 0) for _, n in self.tokens]
        self.begins = [np.cumsum(n) - n for n in self.sizes]

    def slices(self, con: duckdb.DuckDBPyConnection) -> Iterator[_Slice]:
        """The pieces that documents have, about SLICE_BYTES at a time."""
        used = np.flatnonzero(self.counts)
        weight = self.sizes[1][used] * 4  # some four bytes a token
        part = (np.cumsum(weight) - weight) // SLICE_BYTES
        for at in np.split(used, np.flatnonzero(np.diff(part)) + 1) if len(used) else ():
            yield _Slice(con, at, self.counts[at], [self._tokens(at, k) for k in range(2)], self.sides)

    def _tokens(self, at: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these pieces in a row, and how many each has."""
        ids, n = self.tokens[side][0], self.sizes[side]
        own = n[at]
        return ids[np.arange(int(own.sum())) + np.repeat(self.begins[side][at] - (np.cumsum(own) - own), own)], own


def _connect(spill: str) -> duckdb.DuckDBPyConnection:
    return duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": spill, "preserve_insertion_order": False})


def align(docs: DataFrame, first: bytes, second: bytes, link: str = "ends", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups: each document's tokens by both vocabularies (the bytes of a
    tokenizers JSON file of byte-level merges and of a SentencePiece model), side by side.

    Groups are cut where tokens of both sides end; groups spells their ids, as in 1,2|7;3|8,9. A link is a pair of tokens whose
    ranges end together (or, by link="overlaps", share a byte). A pair of ids counts as often as links of the corpus hold it; n_best
    links have the highest count of all pairs of their second id, ties included, and count_sum adds the counts up. Texts that are
    null or empty, or that the second vocabulary doesn't spell as they are, have no tokens: zeros, and groups is ''. Rows with equal
    ids or texts are documents of their own, an empty table gives no rows, other columns aren't looked at. A block's
    texts, and the tokens of its different pieces, are in memory at once.
    """
    if link not in LINKS:
        raise ValueError(f"link is one of {', '.join(LINKS)}")
    own = docs.select(F.col(id_col).alias("doc_id"), whole(F.col(text_col)).alias("text"))
    id_type = own.schema["doc_id"].dataType.simpleString()
    own, n_blocks = deal(own, "text", BLOCK_BYTES)

    def census(table: pa.Table) -> pa.Table:
        block = _Block(table.column("text").to_pylist(), _vocabularies(first, second))
        with tempfile.TemporaryDirectory() as spill, _connect(spill) as con:
            con.execute("create temp table found (a int, b int, n bigint)")
            for part in block.slices(con):
                con.register("own", part.pairs(link))
                con.execute("insert into found select * from own")
            got = con.sql("select a, b, sum(n)::bigint as n from found group by all").to_arrow_table()
        return got.add_column(0, "block", pa.array(np.full(got.num_rows, table.column("block")[0].as_py()), pa.int32()))

    def report(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _Block(left.column("text").to_pylist(), _vocabularies(first, second))
        figures = dict(zip(("n_a", "n_b"), block.sizes, strict=True)) | {c: np.zeros(len(block.counts), np.int64) for c in ("n_groups", "n_links", "n_best", "count_sum")}
        groups = [""] * len(block.counts)
        with tempfile.TemporaryDirectory() as spill, _connect(spill) as con:
            con.register("counts", right)
            con.execute("create temp table pair as select a, b, total, best from counts")
            for part in block.slices(con):
                part.group()
                got = part.figures(link)
                if got.column("n_found") != got.column("n_links"):
                    raise ValueError("the documents are not those whose pairs were counted")
                k = np.asarray(got.column("k"))
                for c in ("n_groups", "n_links", "n_best", "count_sum"):
                    figures[c][k] = np.asarray(got.column(c))
                for where, text in part.texts().items():
                    groups[where] = text
        none = np.zeros(0, np.int64)
        docs = [none if d is None else d for d in block.docs]
        columns = {c: pa.array([int(v[d].sum()) for d in docs], pa.int64()) for c, v in figures.items()}
        texts = pa.array([";".join([groups[k] for k in d.tolist()]) for d in docs], pa.string())
        return pa.table({"doc_id": left.column("doc_id")} | columns | {"groups": texts})

    by_block = own.groupBy("block")
    partial = cut(by_block.applyInArrow(census, "block int, a int, b int, n long"))
    deals = max(1, n_blocks // BLOCKS_EACH)
    totals = pair_totals(partial).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    told = partial.select("block", "a", "b", F.pmod("block", F.lit(deals)).alias("part")).join(totals, ["a", "b", "part"]).drop("part")
    return by_block.cogroup(told.groupBy("block")).applyInArrow(
        report, f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    )


def pair_totals(partial: DataFrame) -> DataFrame:
    """a, b, total, best: the counts of blocks added up, and whether no pair of b counts more. A b has at most a vocabulary of rows."""
    totals = partial.groupBy("a", "b").agg(F.sum("n").alias("total"))
    return totals.withColumn("best", F.col("total") == F.max("total").over(W.partitionBy("b")))
