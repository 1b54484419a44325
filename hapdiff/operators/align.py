"""Reads to positions: validity, as-of mapping, counts by locus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hapdiff.operators.names import fresh
from hapdiff.operators.ordered import running_sum

#: Index positions are looked up in bins of this many bases, each a row with a bit for each base of it and of the next one.
BIN, WORD = 4096, 64
WORDS = 2 * BIN // WORD
#: Bins whose rows are made together: some 1.5 MB.
RUN = 1024
#: Positions in a part along which events are summed up in one task.
EVENTS = 1 << 16
#: The index is broadcast where its rows (8 bytes of bits and 4 of counts for each word) take this much at most; else reads are
#: dealt by bin, once.
BROADCAST_BYTES = 32 << 20
BIN_BYTES = 12 * WORDS + 64
POSITION_BYTES = 96


def finite(c: Column) -> Column:
    """Null where c is; NaN is above all numbers."""
    return F.abs(c) < float("inf")


def annotation_of(df: DataFrame) -> list[str]:
    """The column that names a row's index, where samples have one each; none where all share one."""
    return [c for c in ("annotation",) if c in df.columns]


def position_index(positions: DataFrame) -> DataFrame:
    """chr, pos, ci (and annotation, if positions has it): the distinct positions >= 1 of each chromosome, numbered from 1."""
    ok = positions.filter(F.col("chr").isNotNull() & (F.col("chr") != "") & finite(F.col("pos").cast("double")) & (F.col("pos") >= 1))
    keys = [*annotation_of(positions), "chr"]
    own = ok.select(*keys, F.col("pos").cast("long").alias("pos")).dropDuplicates()
    return running_sum(own, keys, F.lit(1), "ci").withColumn("ci", F.col("ci").cast("int")).select(*keys, "pos", "ci")


def index_spans(reads: DataFrame) -> DataFrame:
    """chr, lo, hi that reads cover: what of an index is needed."""
    return reads.groupBy("chr").agg(F.min("read_start").alias("lo"), F.max("read_end").alias("hi"))


def needed_positions(positions: DataFrame, reads: DataFrame) -> DataFrame:
    """The positions within the reads' spans (one row a chromosome, so the spans are broadcast)."""
    return positions.join(F.broadcast(index_spans(reads)), "chr").filter(F.col("pos").between(F.col("lo"), F.col("hi"))).select(*positions.columns)


def valid_record(require_hap: bool = True) -> Column:
    c = F.col
    ok = c("chr").isNotNull() & (c("chr") != "") & finite(c("read_start")) & finite(c("read_end")) & (c("read_start") <= c("read_end"))
    ok = ok & finite(c("cnt")) & (c("cnt") > 0) & F.coalesce(c("strand").isin("+", "-"), F.lit(False))
    return F.coalesce(ok & c("hap").rlike("^[01]+$") if require_hap else ok, F.lit(False))


def collapse(reads: DataFrame) -> DataFrame:
    """Identical records as one: the sum of their counts and n_records."""
    return reads.groupBy("sample", "chr", "read_start", "read_end", "hap", "strand").agg(F.sum("cnt").alias("cnt"), F.count("*").alias("n_records"))


def _bin(c: Column) -> Column:
    return F.floor(c / BIN)


def _key(df: DataFrame) -> Column:
    return F.concat_ws("\x1f", *annotation_of(df), "chr")


def _ends(cpg: DataFrame) -> DataFrame:
    """index_key, first and last bin of its positions, and how many they are: a row for each index and chromosome."""
    return cpg.groupBy(_key(cpg).alias("ends_key")).agg(_bin(F.min("pos")).alias("index_first"), _bin(F.max("pos")).alias("index_last"), F.count("*").alias("index_all"))


def _bits(at: np.ndarray, n_bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n_bins bins the bits of its own and the next bin's bases by word, and how many positions come before each word; at:
    the positions' distinct distances from the first bin's first base, up to those of the bin behind the last."""
    half = WORDS // 2
    words = np.zeros((n_bins + 1) * half, np.uint64)
    np.bitwise_or.at(words, at // WORD, np.uint64(1) << (at % WORD).astype(np.uint64))
    count = np.bincount(at // WORD, minlength=len(words)).reshape(-1, half)
    words = words.reshape(-1, half)
    both = np.concatenate([count[:-1], count[1:]], axis=1)
    return np.concatenate([words[:-1], words[1:]], axis=1).view(np.int64), (np.cumsum(both, axis=1) - both).astype(np.int32)


def _bins(cpg: DataFrame) -> DataFrame:
    """index_key, index_bin, index_before, index_mask, index_upto: for every bin from that before a chromosome's first to its last,
    the positions before the bin; bits for the positions of it and the next bin by word; and how many of them come before each word.

    Runs of RUN bins are made at once. The positions before a run are summed over runs, some hundreds a genome.
    """
    run = lambda c: F.floor((_bin(c) + 1) / RUN).cast("long")  # noqa: E731  a run's last bin sees the next run's first
    own = cpg.select(_key(cpg).alias("index_key"), F.col("pos").cast("long").alias("pos"))
    spans = _ends(cpg).select(F.col("ends_key").alias("index_key"), "index_first", "index_last")
    runs = spans.withColumn("run", F.explode(F.sequence(F.floor(F.col("index_first") / RUN).cast("long"), F.floor((F.col("index_last") + 1) / RUN).cast("long"))))
    counts = own.groupBy("index_key", run(F.col("pos")).alias("run")).agg(F.count("*").alias("n"))
    w = W.partitionBy("index_key").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.join(counts, ["index_key", "run"], "left").withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    mine = run(F.col("pos"))
    last = F.when(run(F.col("pos") - BIN) < mine, mine - 1)  # in a run's first bin: the run before looks at it too
    sent = own.select("index_key", "pos", F.explode(F.array_compact(F.array(mine, last))).alias("run"))
    held = runs.join(sent, ["index_key", "run"], "left").select("index_key", "run", "before", "index_first", "index_last", "pos")

    def make(table: pa.Table) -> pa.Table:
        row = {c: table.column(c)[0].as_py() for c in ("index_key", "run", "before", "index_first", "index_last")}
        first = row["run"] * RUN - 1
        mask, upto = _bits(np.asarray(table.column("pos").drop_null(), np.int64) - first * BIN, RUN)
        before = row["before"] + np.r_[0, np.cumsum(np.bitwise_count(mask[:, : WORDS // 2].view(np.uint64)).sum(axis=1, dtype=np.int64))[:-1]]
        keep = np.arange(max(row["index_first"] - 1 - first, 0), min(row["index_last"] - first, RUN - 1) + 1)
        lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1) * WORDS, pa.int32()), pa.array(values[keep].ravel(), kind))
        return pa.table({
            "index_key": pa.array([row["index_key"]] * len(keep), pa.string()), "index_bin": pa.array(first + keep), "index_before": pa.array(before[keep]),
            "index_mask": lists(mask, pa.int64()), "index_upto": lists(upto, pa.int32()),
        })

    return held.groupBy("index_key", "run").applyInArrow(make, "index_key string, index_bin long, index_before long, index_mask array<long>, index_upto array<int>")


def _inside(x: Column) -> Column:
    """How many positions are at most x, a whole number, by the row of a bin that holds x in its first or second half.

    Shifts and masks only: what Spark generates for a stage has to stay small enough for the JVM to compile it.
    """
    at = x - F.col("index_bin") * BIN
    low = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (WORD - 1 - at.bitwiseAND(F.lit(WORD - 1))).cast("int"))
    word = F.shiftright(at, WORD.bit_length() - 1).cast("int")
    return F.col("index_before") + F.get("index_upto", word) + F.bit_count(F.get("index_mask", word).bitwiseAND(low))


def _bin_of(x: Column) -> Column:
    return F.shiftright(x, BIN.bit_length() - 1)


def _looked_up(df: DataFrame, side: DataFrame, first: str, names: dict[str, str]) -> DataFrame:
    """df with a count for each name of the column that it is given, all of them within two bins from the bin of `first`."""
    kept = [c for c in df.columns if c not in names]
    out = df.join(side, (F.col("ends_key") == F.col("index_key")) & (_bin_of(F.col(first)) == F.col("index_bin")), "left")
    beyond = lambda x: F.when(_bin_of(F.col(x)) > F.col("index_last"), F.col("index_all")).otherwise(F.lit(0))
    counts = F.struct(*[F.coalesce(_inside(F.col(x)), beyond(x), F.lit(0)).cast("int").alias(name) for name, x in names.items()])
    # behind a generator no later filter makes Spark look up anew
    return out.select(*kept, F.explode(F.array(counts)).alias("index_found")).select(*kept, "index_found.*")


def count_at_most(df: DataFrame, cpg: DataFrame, **wanted: Column) -> DataFrame:
    """df and, for each name, the number of index positions of its chromosome that are at most the given value (0 without any).

    Values are in ascending order, such as a span's ends. The index is broadcast where the size of its bins, counted first, allows
    it. Else rows are dealt by the bin of the first value, whose row answers for the next bin too; only rows that reach farther
    are dealt again, by each other value.
    """
    bins = cpg.groupBy(_key(cpg)).agg((_bin(F.max("pos")) - _bin(F.min("pos")) + 2).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    side, small = _bins(cpg), bins * BIN_BYTES <= BROADCAST_BYTES
    values = {name: fresh(df, f"value_of_{name}") for name in wanted}
    out = df.withColumns({values[name]: F.floor(value.cast("double")) for name, value in wanted.items()}).withColumn("reads_key", _key(df if annotation_of(cpg) else df.select("chr")))
    out = out.join(F.broadcast(_ends(cpg)), F.col("reads_key") == F.col("ends_key"), "left")
    first, *others = values.values()
    if small or not others:
        for name, x in values.items():
            out = _looked_up(out, F.broadcast(side) if small else side, x, {name: x})
    else:
        reach = F.array_max(F.array(*[_bin_of(F.col(x)) for x in others])) - _bin_of(F.col(first))
        near = F.coalesce(reach.between(0, 1) & _bin_of(F.col(first)).between(F.col("index_first") - 1, F.col("index_last")), F.lit(False))
        far = out.filter(~near)
        for name, x in values.items():
            far = _looked_up(far, side, x, {name: x})
        out = _looked_up(out.filter(near), side, first, values).unionByName(far)
    return out.drop("reads_key", "ends_key", "index_first", "index_last", "index_all", *values.values())


def map_reads(reads: DataFrame, cpg: DataFrame) -> DataFrame:
    """reads with ci_start, ci_end (the positions p with read_start - 1 < p <= read_end), is_valid, bad_hap,
    missing_annotation, length_mismatch, mapping_valid and state (some character of the string is 1)."""
    out = reads.withColumn("is_valid", valid_record()).withColumn("bad_hap", ~F.coalesce(F.col("hap").rlike("^[01]+$"), F.lit(False)))
    out = count_at_most(out, cpg, ci_start=F.col("read_start") - 1, ci_end=F.col("read_end")).withColumn("ci_start", F.col("ci_start") + 1)
    covered = F.col("ci_end") - F.col("ci_start") + 1
    out = out.withColumn("missing_annotation", F.col("is_valid") & (covered <= 0))
    out = out.withColumn("length_mismatch", F.col("is_valid") & (covered > 0) & (covered != F.length("hap")))
    out = out.withColumn("mapping_valid", F.col("is_valid") & ~F.col("missing_annotation") & ~F.col("length_mismatch"))
    return out.withColumn("state", F.instr("hap", "1") > 0)


#: The counters of mapped reads.
QC = ("total_records", "valid_records", "invalid_records", "invalid_haplotype_string", "missing_cpg_annotation", "cpg_length_mismatch")


def qc_counters() -> list[Column]:
    """The counters of map_reads()'s rows; a bad string counts whatever else is wrong, the mapping flags only for otherwise valid records."""
    return [
        F.count(F.lit(1)).alias("total_records"), F.count_if("mapping_valid").alias("valid_records"),
        F.count_if(~F.col("mapping_valid")).alias("invalid_records"), F.count_if("bad_hap").alias("invalid_haplotype_string"),
        F.count_if("missing_annotation").alias("missing_cpg_annotation"), F.count_if("length_mismatch").alias("cpg_length_mismatch"),
    ]


def observed(seen: Observation) -> dict[str, int]:
    """What qc_counters() counted as the rows passed; nothing is reported of a plan that Spark knows to be empty, which has zeros."""
    found = dict(seen._jo.getAsJava())
    return {c: int(found.get(c, 0)) for c in QC}


def read_qc(mapped: DataFrame) -> DataFrame:
    """One row of counters."""
    return mapped.agg(*qc_counters())


def distinct_spans(mapped: DataFrame) -> DataFrame:
    """Valid reads by sample and span: their count, and nd, how many different (hap, strand) they have."""
    return mapped.filter("mapping_valid").groupBy("sample", "chr", "read_start", "read_end", "ci_start", "ci_end").agg(
        F.sum("cnt").alias("cnt"), F.count_distinct("hap", "strand").alias("nd")
    )


def _with_position(loci: DataFrame, cpg: DataFrame, keys: list[str]) -> DataFrame:
    """loci (with ci) and pos. The index is broadcast where its rows, counted first, take BROADCAST_BYTES at most."""
    small = cpg.count() * POSITION_BYTES <= BROADCAST_BYTES
    return loci.join(F.broadcast(cpg) if small else cpg, [*keys, "ci"])


def locus_counts(mapped: DataFrame, cpg: DataFrame) -> DataFrame:
    """sample, chr, pos, t, s, m: a read counts at every position that it covers, in its whole-read state.

    Reads of one sample, span and state are summed before they are spread over positions.
    """
    keys = [*annotation_of(cpg), "chr"]
    spans = mapped.filter("mapping_valid").groupBy("sample", *keys, "ci_start", "ci_end").agg(
        F.sum("cnt").alias("t"), F.sum(F.when(F.col("state"), F.col("cnt")).otherwise(0.0)).alias("s")
    )
    at = spans.select("sample", *keys, F.explode(F.sequence("ci_start", "ci_end")).alias("ci"), "t", "s")
    loci = at.groupBy("sample", *keys, "ci").agg(F.sum("t").alias("t"), F.sum("s").alias("s"))
    return _with_position(loci, cpg, keys).select("sample", "chr", "pos", "t", "s", (F.col("s") / F.col("t")).alias("m"))


def locus_counts_by_events(mapped: DataFrame, cpg: DataFrame) -> DataFrame:
    """locus_counts() by running sums of +count at a read's first position and -count after its last; for whole counts."""
    own, keys = mapped.filter("mapping_valid"), [*annotation_of(cpg), "chr"]
    on = F.when(F.col("state"), F.col("cnt")).otherwise(0.0)
    event = lambda at, sign: F.struct(at.alias("ci"), (sign * F.col("cnt")).alias("dt"), (sign * on).alias("ds"))
    events = own.select("sample", *keys, F.explode(F.array(event(F.col("ci_start"), 1.0), event(F.col("ci_end") + 1, -1.0))).alias("e"))
    of = ["sample", *keys]
    events = events.groupBy(*of, "e.ci").agg(F.sum("e.dt").alias("dt"), F.sum("e.ds").alias("ds")).withColumn("part", F.floor(F.col("ci") / EVENTS))
    # sums and the next event within a part; a row for each part carries them over its border
    parts = events.groupBy(*of, "part").agg(F.sum("dt").alias("t0"), F.sum("ds").alias("s0"), F.min("ci").alias("begin"))
    over = W.partitionBy(*of).orderBy("part")
    before = lambda c: F.coalesce(F.sum(c).over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias(c)
    parts = parts.select(*of, "part", before("t0"), before("s0"), F.lead("begin").over(over).alias("begin"))
    w = W.partitionBy(*of, "part").orderBy("ci")
    steps = events.join(parts, [*of, "part"]).select(
        *of, F.coalesce(F.lead("ci").over(w), "begin").alias("nxt"), "ci", (F.col("t0") + F.sum("dt").over(w)).alias("t"), (F.col("s0") + F.sum("ds").over(w)).alias("s")
    ).filter("nxt is not null and t > 0")
    at = steps.select("sample", *keys, F.explode(F.sequence("ci", F.col("nxt") - 1)).alias("ci"), "t", "s")
    return _with_position(at, cpg, keys).select("sample", "chr", "pos", "t", "s", (F.col("s") / F.col("t")).alias("m"))


def dense(loci: DataFrame, samples: list[str]) -> DataFrame:
    """chr, pos, s, t: arrays in the order of samples, 0 where uncovered. An unknown sample stops the job.

    Of rows that repeat a position and sample the last counts, in the order in which loci is read.
    """
    place = F.array_position(F.array(*[F.lit(x) for x in samples]), F.col("sample"))
    known = F.when(place > 0, place).otherwise(F.raise_error("unknown sample").cast("bigint"))
    own = loci.select("chr", "pos", "s", "t", known.alias("place"), F.monotonically_increasing_id().alias("row"))
    pick = lambda c, k: F.coalesce(F.max_by(c, F.when(F.col("place") == k + 1, F.col("row"))), F.lit(0.0))
    return own.groupBy("chr", "pos").agg(*[F.array(*[pick(c, k) for k in range(len(samples))]).alias(c) for c in ("s", "t")])


def long(wide: DataFrame, samples: list[str]) -> DataFrame:
    """locus_counts()'s rows again, t > 0 only."""
    at = wide.select("chr", "pos", F.posexplode(F.arrays_zip("s", "t")).alias("_k", "_v"))
    name = F.get(F.array(*[F.lit(x) for x in samples]), F.col("_k"))
    return at.filter("_v.t > 0").select(name.alias("sample"), "chr", "pos", F.col("_v.t").alias("t"), F.col("_v.s").alias("s"), (F.col("_v.s") / F.col("_v.t")).alias("m"))
