"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every document of a source starts with target / source_size copies. Whole copies are certain;
the fractions are rounded in pairs: words move at random from one document to the other
until one fraction is 0 or 1, each fraction keeping its expectation and the pair its words.
Leaves of about LEAF documents reduce to one residual each and residuals reduce again up a tree.
About RESERVE documents of at most mean size of each source stay out of it until the top: there the last
residual, often the source's largest document, goes to its nearer side against their words,
and what is left over at the end is the fraction of a small document, rounded to the nearer side.

Equal rows (same key, size and source) fold into one with a count; of m of them with fraction p,
floor(m * p) rise and at most one enters the tree. The texts are read once.

A null text has size 0 and takes 0 words; a null source sorts last and is a source like any other;
null and repeated ids keep a row each; very long texts are counted whole. Columns other than doc_id,
text and source are not read by mix(). An empty table gives no rows. Randomness is a hash of ids, so
reruns agree. The windows over the sources run in one task: sources are taken to be few against rows.
"""
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, join_hot

WEIGHTS, SHARE, MOST, LEAF, RESERVE = (5, 2, 1), 1.5, 2.0, 48, 96
# Equal rows that are written out by one task.
RUN = 10_000


def sized(docs: DataFrame, key) -> DataFrame:
    """key, source, skey (the source as text that is never null), size."""
    source = F.col("source").cast("string")
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select(key.alias("key"), source.alias("source"), F.when(source.isNull(), "n").otherwise(F.concat(F.lit("v"), source)).alias("skey"), size.alias("size"))


def targets(sizes: DataFrame) -> DataFrame:
    """skey, source_size, n, target: water-filling under the cap of MOST times the size."""
    per = sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    cap = MOST * F.col("source_size")
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (SHARE * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    leveled = per.withColumn("w", w).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("w")).withColumn("level", level)
    free = F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(every)
    return leveled.withColumn("target", F.least("cap", F.coalesce(free * F.col("w"), F.col("cap")))).select("skey", "source_size", "n", "target")


# late: 1 for a document of the reserve. A residual of the tree goes to its nearer side against the reserve.
UNIT = "struct<late:int,place:bigint,h:bigint,key:{key},size:bigint,p:double>"
ROUND = """aggregate(units,
  named_struct('cur', cast(null as {unit}), 'out', cast(array() as array<{unit}>)),
  (acc, x) -> if(acc.cur is null, named_struct('cur', x, 'out', acc.out),
    transform(transform(array(named_struct(
      'up', least((1 - acc.cur.p) * acc.cur.size, x.p * x.size),
      'down', least(acc.cur.p * acc.cur.size, (1 - x.p) * x.size),
      'u', (pmod(xxhash64(acc.cur.h, x.h), 1073741824L) + 0.5) / 1073741824)),
      m -> transform(array(if(acc.cur.late < x.late, acc.cur.p >= 0.5, m.u * (m.up + m.down) < m.down)),
        rise -> named_struct('m', if(rise, m.up, -m.down)))[0]),
      r -> transform(array(named_struct(
        'a', named_struct('late', acc.cur.late, 'place', acc.cur.place, 'h', acc.cur.h, 'key', acc.cur.key, 'size', acc.cur.size, 'p', acc.cur.p + r.m / acc.cur.size),
        'b', named_struct('late', x.late, 'place', x.place, 'h', x.h, 'key', x.key, 'size', x.size, 'p', x.p - r.m / x.size))),
        t -> if(t.a.p < 1e-9 or t.a.p > 1 - 1e-9,
          named_struct('cur', if(t.b.p < 1e-9 or t.b.p > 1 - 1e-9, null, t.b), 'out', concat(acc.out, array(t.a), if(t.b.p < 1e-9 or t.b.p > 1 - 1e-9, array(t.b), array()))),
          named_struct('cur', t.a, 'out', concat(acc.out, array(t.b)))))[0])[0]))"""


def _mix(docs: DataFrame, key) -> DataFrame:
    """key, size, source_size, target, taken and the number of rows that these hold for."""
    sizes = checkpointed(sized(docs, key))
    goal = checkpointed(targets(sizes))
    total, most = goal.agg(F.sum("n"), F.max("n")).first()
    same = sizes.groupBy("key", "skey", "size").agg(F.count("*").alias("m"))
    rows = join_hot(same, goal.withColumn("share", F.col("n")), "skey", total or 0).withColumnRenamed("share", "n")
    copies = F.coalesce(F.expr("target / nullif(source_size, 0)"), F.lit(0.0))
    rows = rows.withColumn("whole", F.least(F.floor(copies), F.lit(int(MOST))).cast("long")).withColumn("p", copies - F.col("whole"))
    rows = rows.withColumn("p", F.when((F.col("size") > 0) & (F.col("p") > 1e-9), F.col("p")).otherwise(0.0)).withColumn("h", F.xxhash64("key", "size", "skey"))
    rows = rows.withColumn("up", F.floor(F.col("m") * F.col("p") + 1e-9)).withColumn("part", F.greatest(F.lit(0.0), F.col("m") * F.col("p") - F.col("up")))
    rows = checkpointed(rows.withColumn("part", F.when(F.col("part") > 1e-9, F.col("part")).otherwise(0.0)))
    keep, group = ["key", "size", "source_size", "target"], ["skey", "source_size", "target", "whole", "n"]
    down = F.col("m") - F.col("up") - (F.col("part") > 0).cast("long")
    sure = F.explode(F.array(F.struct(F.col("up").alias("rows"), (F.col("whole") + 1).alias("c")), F.struct(down.alias("rows"), F.col("whole").alias("c"))))
    done = rows.select(*keep, sure.alias("x")).filter("x.rows > 0").select(*keep, (F.col("x.c") * F.col("size")).alias("taken"), "x.rows")
    late = (F.pmod(F.xxhash64("h", F.lit(7)), F.col("n")) < RESERVE) & (F.col("size") * F.col("n") <= F.col("source_size"))
    # In a block the large come first.
    live = rows.filter("part > 0").select(*group, F.struct(
        late.cast("int").alias("late"), (-F.col("size")).alias("place"), "h", "key", "size", F.col("part").alias("p")).alias("unit"))
    unit = UNIT.format(key=rows.schema["key"].dataType.simpleString())
    levels = max(1, math.ceil(math.log(max(most or 1, 2), LEAF)) + 1)
    waiting = live.filter("unit.late = 1")
    live = live.filter("unit.late = 0")
    for i in range(levels):
        last = i == levels - 1
        # The tree's fan-in follows the source's own row count; the top level has one block.
        blocks = F.lit(1) if last else F.greatest(F.lit(1), F.ceil(F.col("n") / float(LEAF) ** (i + 1)))
        dealt = (live.unionByName(waiting) if last else live).withColumn("block", F.pmod(F.xxhash64(F.col("unit.h"), F.lit(i)), blocks))
        folded = checkpointed(dealt.groupBy(*group, "block").agg(F.array_sort(F.collect_list("unit")).alias("units"))
                              .withColumn("s", F.expr(ROUND.format(unit=unit))).select(*group, "s"))
        ended = F.expr("if(s.cur is null, s.out, concat(s.out, array(s.cur)))") if last else F.col("s.out")
        out = folded.select(*group, F.explode(ended).alias("x"))
        done = done.unionByName(out.select(
            "x.key", "x.size", "source_size", "target",
            ((F.col("whole") + F.when(F.col("x.p") >= 0.5, 1).otherwise(0)) * F.col("x.size")).cast("long").alias("taken"), F.lit(1).cast("long").alias("rows")))
        live = folded.filter("s.cur is not null").select(*group, F.col("s.cur").alias("unit"))
    return done


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row."""
    done = _mix(docs, F.col("doc_id"))
    few = done.filter(F.col("rows") <= RUN)
    # Long runs of equal rows are written by many tasks.
    runs = done.filter(F.col("rows") > RUN).withColumn("run", F.explode(F.expr(f"sequence(0L, (rows - 1) div {RUN})")))
    runs = runs.repartition("key", "run").withColumn("rows", F.least(F.lit(RUN), F.col("rows") - F.col("run") * RUN)).drop("run")
    return few.unionByName(runs).withColumn("copy", F.explode(F.expr("sequence(1L, rows)"))).select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


def mixed(docs: DataFrame) -> DataFrame:
    """Rows that the mix takes, with their number of copies in a further column: `copies`, with underscores behind if that name is taken.

    Rows are told apart by doc_id and a hash of all columns (but maps); equal rows become one, with the copies of all.
    """
    name = "copies"
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    hashed = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString() and docs.schema[c].dataType.simpleString() != "variant"]
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64(*hashed).alias("h"))
    taken = (_mix(docs, key).filter("taken > 0").groupBy("key").agg(F.sum(F.expr("rows * (taken div size)")).cast("int").alias("taken_copies"))
             .select(F.xxhash64("key").alias("k"), F.col("key").alias("whose"), "taken_copies"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key")).withColumn("k", F.xxhash64("key"))
    return (rows.join(taken, "k").filter("key <=> whose").dropDuplicates(["k", "key"])
            .select("row.*", F.col("taken_copies").alias(name)))
