"""Constrained selection: quota solving, interleaving, tiers, versions, sections, and admission."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.functions.text import let
from quillspark.operators.duplicates import first_kept
from quillspark.operators.relational import approved_only
from quillspark.shared import dealt, listed, materialize, numbered


def interleave(df: DataFrame, topic: str, order: list[str]) -> DataFrame:
    """Round robin over topics in the order in which they appear; `turn` numbers the rows."""
    rows = numbered(df, [topic, *order], "_q")
    firsts = rows.groupBy(F.col(topic).alias("_topic")).agg(F.min("_q").alias("_q0"), F.min(F.struct(*order)).alias("_f"))
    rows = rows.join(firsts, F.col(topic).eqNullSafe(F.col("_topic"))).withColumn("_k", F.col("_q") - F.col("_q0"))
    return numbered(rows.select(*df.columns, "_k", "_f"), ["_k", "_f", topic], "turn").drop("_k", "_f")


def _solve(pdf: pd.DataFrame, group: str) -> pd.DataFrame:
    """The fewest of a group's candidates whose worth adds up to its units, or why there are none (see `select_quota`)."""
    pdf = pdf.sort_values(["topic_id", "difficulty", "id"], kind="stable").reset_index(drop=True)
    tried = pdf.sort_values(["turn", "topic_id"], kind="stable").index.to_numpy()
    worth, units, most = pdf["worth"].to_numpy(), int(pdf["units"].iloc[0]), pdf["most"].iloc[0]
    most = None if pd.isna(most) or most <= 0 else int(most)

    def reach(cap: int | None) -> tuple[np.ndarray, np.ndarray]:
        """For each sum the fewest questions that make it (too many: none do), and the list of these."""
        none = len(tried) + 1
        fewest, picked = np.full(units + 1, none), np.empty(units + 1, object)
        fewest[0] = 0
        for i in tried[worth[tried] <= units]:
            more = fewest[: units + 1 - worth[i]] + 1
            better = np.flatnonzero((more < fewest[worth[i] :]) & (more <= (cap or none - 1)))
            lists = [(i, picked[k]) for k in better]  # from the state before this question
            fewest[better + worth[i]] = more[better]
            for k, x in zip(better + worth[i], lists, strict=True):
                picked[k] = x
        return np.flatnonzero(fewest < none), picked

    name = pdf[group].iloc[0]
    row = lambda outcome: pd.DataFrame({group: [name], "id": [None], "outcome": [outcome]})
    if pdf["whole"].iloc[0] < units:
        return row("pool_too_small")
    sums, picked = reach(most)
    if units in sums:
        rows, rest = [], picked[units]
        while rest:
            rows.append(rest[0])
            rest = rest[1]
        return pd.DataFrame({group: name, "id": [pdf["id"][i] for i in sorted(rows)], "outcome": "ok"})
    if most and units in reach(None)[0]:
        return row("needs_more_than_max")
    return row(f"closest:{sums[np.abs(sums - units).argmin()] / 2:g}")


def _units(marks: Column) -> Column:
    return F.rint(marks.cast("double") * 2).cast("long")


def _ranked_pool(pool: DataFrame, group: str) -> DataFrame:
    """The pool with worth, turn (the rank in its topic), like (the rank among those of one worth, in the order of trial)
    and whole (the worth of its group)."""
    rows = pool.select(group, "id", "topic_id", "difficulty", _units(F.col("marks")).alias("worth"))
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy(group, "topic_id").orderBy("difficulty", "id")))
    rows = rows.withColumn("like", F.row_number().over(Window.partitionBy(group, "worth").orderBy("turn", "topic_id")))
    whole = rows.groupBy(F.col(group).alias("_group")).agg(F.sum("worth").alias("whole"))
    return rows.join(whole, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def select_quota(pool: DataFrame, group: str, target: float, most: int | None = None) -> DataFrame:
    """(group, id, outcome): for each group the fewest questions whose marks add up to the target exactly.

    pool: (group, id, topic_id, difficulty, marks). Marks count in halves. Candidates are tried round robin over the
    topics; among equally small choices the first one found stays. Without an exact sum the row has a null id and the
    outcome says why: pool_too_small, needs_more_than_max or closest:<marks>. Of candidates with the same marks only the
    first target / marks in the order of trial can be chosen, so only these are gathered, with the sum of all marks.
    """
    units = round(target * 2)
    kind = pool.schema[group].dataType.simpleString()
    tried = _ranked_pool(pool, group)
    # the first one of each worth stands for those that can't be chosen, so that each group has a row
    tried = tried.where((F.col("like") == 1) | ((F.col("worth") > 0) & (F.col("like") * F.col("worth") <= units)))
    tried = tried.withColumn("units", F.lit(units)).withColumn("most", F.lit(most).cast("int"))
    return tried.groupBy(group).applyInPandas(lambda pdf: _solve(pdf, group), f"{group} {kind}, id long, outcome string")


def tier_counts(split: dict[str, float], total: int | None) -> dict[str, int]:
    """Questions by tier; values are percentages if they add up to 100 at most, one exceeds 10 and a total is given."""
    if total and sum(split.values()) <= 100 and any(v > 10 for v in split.values()):
        return {k: int(round(total * v / 100)) for k, v in split.items()}
    return {k: int(v) for k, v in split.items()}


def select_tiers(pool: DataFrame, column: str, counts: dict, order: list[str]) -> DataFrame:
    """The first rows of each tier value, as many as its count."""
    n = F.create_map(*(F.lit(x) for kv in counts.items() for x in kv))
    w = Window.partitionBy(column).orderBy(*order)
    return pool.where(F.col(column).isin(*counts)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= F.try_element_at(n, F.col(column))).drop("_n")


SPEC = "subject_breakdown array<struct<subject:string,marks:double,count:int>>, difficulty_distribution array<struct<level:string,n:int>>, mark_distribution array<struct<marks:double,count:int,formats:array<string>>>, total_marks double, quantity int"


def _quotas(tasks: DataFrame, pool: DataFrame) -> DataFrame:
    """(task, id, outcome) of tasks (task, own, marks, n): with marks by their sum (n at most), else the first n round robin
    over the topics. pool: (own, id, topic_id, difficulty, marks), and each `own` of a task has rows."""
    pool = pool.join(tasks.select("own").distinct(), "own", "left_semi")
    ranked = materialize(_ranked_pool(pool, "own"), "ranked")
    summed = tasks.where("marks > 0").withColumn("units", _units(F.col("marks"))).withColumnRenamed("n", "most")
    # a task meets the questions of each worth by their rank, as many as could be in its sum
    worths = ranked.select("own", "worth").distinct()
    ranks = summed.join(worths, "own").withColumn("like", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.when(F.col("worth") > 0, F.floor(F.col("units") / F.col("worth"))).otherwise(1)).cast("int"))))
    solved = ranks.join(ranked, ["own", "worth", "like"]).drop("own").groupBy("task").applyInPandas(lambda pdf: _solve(pdf, "task"), "task string, id long, outcome string")
    counted = tasks.where("coalesce(marks, 0) <= 0 and n > 0")
    robin = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("own").orderBy("turn", "topic_id"))).select("own", "id", "rank")
    some = counted.withColumn("rank", F.explode(F.sequence(F.lit(1), "n"))).join(robin, ["own", "rank"]).select("task", "id", F.lit("ok").alias("outcome"))
    return solved.unionByName(some)


@F.pandas_udf(StringType())
def _too_few(marks: pd.Series, n: pd.Series, there: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(k) else f"too_few:{m:g}:{k:.0f}:{x:.0f}" for m, k, x in zip(marks, n, there, strict=True)], dtype=object)


def _serve_marks(seen: DataFrame) -> DataFrame:
    """(paper_id, id, outcome) of the candidates (paper_id, k, marks, n, id, topic_id, difficulty) of the entries of marks of
    papers, each entry in turn taking the first n that no earlier one has."""
    order = F.struct(F.col("topic_id").isNull().alias("t"), "topic_id", F.col("difficulty").isNull().alias("d"), "difficulty", "id")
    entry = seen.repartition("paper_id").groupBy("paper_id", "k").agg(F.first("marks").alias("marks"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), order)))["id"].alias("ids"))
    start = F.struct(F.array().cast("array<long>").alias("taken"), F.lit(None).cast("struct<marks:double,n:int,there:int>").alias("short"))

    def serve(acc: Column, x: Column) -> Column:
        def go(free: Column) -> Column:
            short = F.when(F.size(free) < x["n"], F.struct(x["marks"].alias("marks"), x["n"].alias("n"), F.size(free).alias("there")))
            return F.struct(F.concat(acc["taken"], F.slice(free, F.lit(1), x["n"])).alias("taken"), F.coalesce(acc["short"], short).alias("short"))

        return let(F.array_except(x["ids"], acc["taken"]), go)

    walked = entry.groupBy("paper_id").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("k", "marks", "n", "ids"))), start, serve).alias("w"))
    served = walked.select("paper_id", "w.taken", _too_few("w.short.marks", "w.short.n", "w.short.there").alias("short"))
    ids = F.when(F.col("short").isNull(), F.col("taken")).otherwise(F.array(F.lit(None).cast("long")))
    return served.select("paper_id", F.explode(ids).alias("id"), F.coalesce("short", F.lit("ok")).alias("outcome"))


def select_for_specifications(specs: DataFrame, pool: DataFrame) -> DataFrame:
    """(paper_id, id, outcome): the questions of each paper, by the first part of its specification that asks for anything.

    specs: (paper_id, pool_id, and the columns of SPEC), paper_id unique; pool: (pool_id, id, topic_id, difficulty, marks,
    question_type, subject, position). Parts in this order: subject_breakdown (marks or count of each subject; of the same
    name, or the first that holds it or is part of it), difficulty_distribution (counts, or percentages of quantity),
    mark_distribution (no question serves two entries), and total_marks with a most of quantity, or quantity alone. A
    specification that asks for nothing gives its pool. Where a part can't be met the paper has one row with a null id and
    the outcome of its first entry that fails: no_questions:<subject>, <subject>:<outcome>, too_few:<what>:<asked>:<there>,
    pool_too_small, needs_more_than_max or closest:<marks>. A paper whose pool is empty has no row.

    Pools are ranked once, and papers meet them by rank: no paper's pool is copied, and many papers take one pass. Rows of
    whole pools are written nowhere on their way.
    """
    pool = materialize(pool.withColumn("_own", F.coalesce(F.nullif(F.lower(F.trim("subject")), F.lit("")), F.lit("general"))).withColumn("marks", F.col("marks").cast("double")), "pool")
    specs = specs.join(pool.select("pool_id").distinct(), "pool_id", "left_semi")
    level = F.transform("difficulty_distribution", lambda x: F.struct(F.upper(x["level"]).alias("level"), F.coalesce(x["n"], F.lit(0)).alias("n")))
    share = F.aggregate(level, F.lit(0), lambda a, x: a + x["n"])
    percent = (F.col("quantity") > 0) & (share <= 100) & F.exists(level, lambda x: x["n"] > 10)
    level = F.transform(level, lambda x: F.struct(x["level"].alias("level"), F.when(percent, F.rint(F.col("quantity") * x["n"] / 100).cast("int")).otherwise(x["n"]).alias("n")))
    specs = specs.withColumn("levels", F.filter(level, lambda x: x["n"] > 0)).withColumn("entries", F.filter("mark_distribution", lambda x: x["marks"].isNotNull() & (x["count"] > 0)))
    has = lambda c: F.size(F.coalesce(c, F.array().cast(specs.schema[c].dataType))) > 0
    specs = materialize(specs.withColumn("part", F.when(has("subject_breakdown"), "subjects").when(has("levels"), "levels").when(has("entries"), "entries").otherwise("quota")), "specs")
    part = lambda name: specs.where(F.col("part") == name)
    ok = F.lit("ok").alias("outcome")
    refused = lambda rows, why: rows.groupBy("paper_id").agg(F.min(F.struct("k", why.alias("outcome"))).alias("m")).select("paper_id", F.lit(None).cast("long").alias("id"), "m.outcome")

    # difficulties: the first n of each by position
    asked = part("levels").select("paper_id", "pool_id", F.posexplode("levels").alias("k", "x")).select("paper_id", "pool_id", "k", F.col("x.level").alias("difficulty"), "x.n")
    there = pool.groupBy("pool_id", "difficulty").agg(F.count("*").alias("there"))
    asked = materialize(asked.join(there, ["pool_id", "difficulty"], "left").withColumn("there", F.coalesce("there", F.lit(0))), "levels")
    short = refused(asked.where("there < n"), F.concat_ws(":", F.lit("too_few"), "difficulty", F.col("n").cast("string"), F.col("there").cast("string")))
    placed = pool.withColumn("rank", F.row_number().over(Window.partitionBy("pool_id", "difficulty").orderBy("position"))).select("pool_id", "difficulty", "rank", "id")
    by_level = asked.join(short, "paper_id", "left_anti").withColumn("rank", F.explode(F.sequence(F.lit(1), "n"))).join(placed, ["pool_id", "difficulty", "rank"]).select("paper_id", "id", ok).unionByName(short)

    # marks: each entry looks at as many as it and the entries before it could take of each of its formats
    entry = part("entries").select("paper_id", "pool_id", F.posexplode("entries").alias("k", "x"), "entries").select("paper_id", "pool_id", "k", "x.marks", F.col("x.count").alias("n"), F.when(F.size("x.formats") > 0, F.array_distinct("x.formats")).otherwise(F.array(F.lit("*"))).alias("formats"), F.aggregate(F.slice("entries", F.lit(1), F.col("k") + 1), F.lit(0), lambda a, x: a + x["count"]).alias("most"))
    keyed = pool.withColumn("format", F.explode(F.array("question_type", F.lit("*"))))
    keyed = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("pool_id", "marks", "format").orderBy("topic_id", "difficulty", "id"))).select("pool_id", "marks", "format", "rank", "id", "topic_id", "difficulty")
    wanted = entry.withColumn("format", F.explode("formats")).withColumn("rank", F.explode(F.sequence(F.lit(1), "most")))
    seen = wanted.join(keyed, ["pool_id", "marks", "format", "rank"], "left").where("id is not null or rank = 1")
    by_marks = _serve_marks(seen.select("paper_id", "k", "marks", "n", "id", "topic_id", "difficulty"))

    # sums and counts, of whole pools and of subjects
    asked = part("subjects").select("paper_id", "pool_id", F.posexplode("subject_breakdown").alias("k", "x")).select("paper_id", "pool_id", "k", "x.subject", "x.marks", F.col("x.count").alias("n")).withColumn("_w", F.lower(F.trim(F.coalesce("subject", F.lit("")))))
    subjects = pool.groupBy("pool_id", "_own").agg(F.min("position").alias("first"))
    pairs = asked.select("pool_id", "_w").distinct().join(subjects, "pool_id").where((F.col("_own") == F.col("_w")) | F.contains("_own", F.col("_w")) | F.contains(F.col("_w"), F.col("_own")))
    best = pairs.groupBy("pool_id", "_w").agg(F.min_by("_own", F.struct(F.col("_own") != F.col("_w"), "first")).alias("_own"))
    asked = materialize(asked.join(best, ["pool_id", "_w"], "left"), "subjects")
    unknown = asked.where("_own is null").select("paper_id", "k", F.concat(F.lit("no_questions:"), F.coalesce("subject", F.lit(""))).alias("outcome"))
    task = lambda k: F.concat(k.cast("string"), F.lit("/"), F.col("paper_id").cast("string")).alias("task")
    own = lambda subject: F.struct("pool_id", subject.alias("subject")).alias("own")
    every = F.lit("*")
    whole = F.lit(-1).alias("k")
    tasks = part("quota").select(task(F.lit(-1)), "paper_id", whole, own(every), F.col("total_marks").alias("marks"), F.col("quantity").alias("n"))
    tasks = tasks.unionByName(asked.where("_own is not null").select(task(F.col("k")), "paper_id", "k", own(F.concat(F.lit("="), "_own")), "marks", "n"))
    tasks = materialize(tasks, "tasks")
    pools = pool.withColumn("own", F.explode(F.array(own(every), own(F.concat(F.lit("="), "_own"))))).select("own", "id", "topic_id", "difficulty", "marks")
    every_one = (F.coalesce("marks", F.lit(0.0)) <= 0) & (F.coalesce("n", F.lit(0)) <= 0)
    got = materialize(_quotas(tasks.where(~every_one).select("task", "own", "marks", "n"), pools).join(tasks.select("task", "paper_id", "k"), "task"), "quotas").select("paper_id", "k", "id", "outcome")
    bad = got.where("outcome <> 'ok'").join(asked.select("paper_id", "k", "subject"), ["paper_id", "k"], "left").select("paper_id", "k", F.when(F.col("k") < 0, F.col("outcome")).otherwise(F.concat_ws(":", F.coalesce("subject", F.lit("")), "outcome")).alias("outcome"))
    short = refused(bad.unionByName(unknown), F.col("outcome"))
    by_quota = got.where("outcome = 'ok'").select("paper_id", "id", "outcome").join(short, "paper_id", "left_anti").unionByName(short)
    # whole pools: lists of papers meet lists of questions, and rows are made where they are used
    papers = listed(tasks.where(every_one).join(short, "paper_id", "left_anti"), "own", "paper_id", "papers")
    ids = listed(pools.join(tasks.where(every_one).select("own").distinct(), "own", "left_semi"), "own", "id", "ids")
    by_pool = dealt(papers.join(ids, "own").select("papers", "ids")).select("papers", F.explode("ids").alias("id")).select(F.explode("papers").alias("paper_id"), "id", ok)
    return by_level.unionByName(by_marks).unionByName(by_quota).unionByName(by_pool)


def select_for_specification(pool: DataFrame, spec: dict) -> tuple[DataFrame, str | None]:
    """(chosen rows of the pool, None), or (no rows, why not), for one specification as `select_for_specifications` reads
    it: a list of subject with marks or count, a dict of difficulties, a list of marks, count and formats, total_marks and
    total_question_count or quantity."""
    number = lambda x: None if x is None else float(x)
    total = spec.get("total_question_count") or spec.get("quantity")
    levels = tier_counts({k: float(v or 0) for k, v in (spec.get("difficulty_distribution") or {}).items()}, total)
    formats = lambda x: [x] if isinstance(x, str) else list(x)
    row = (
        0, 0, [(x.get("subject"), number(x.get("marks")), x.get("count") or x.get("quantity")) for x in spec.get("subject_breakdown") or []], list(levels.items()),
        [(number(x.get("marks")), int(x.get("count") or 0), formats(x.get("question_types") or x.get("formats") or [])) for x in spec.get("mark_distribution") or []], number(spec.get("total_marks")), int(total) if total else None,
    )
    specs = pool.sparkSession.createDataFrame([row], f"paper_id int, pool_id int, {SPEC}")
    # the levels are counts by now, whatever the quantity
    specs = specs.withColumn("quantity", F.when(F.size("difficulty_distribution") == 0, F.col("quantity")))
    got = materialize(select_for_specifications(specs, pool.withColumn("pool_id", F.lit(0))), "chosen")
    bad = got.where("outcome <> 'ok'").first()
    return (pool.limit(0), bad.outcome) if bad else (pool.join(got.select("id"), "id", "left_semi").select(*pool.columns), None)


def seeded_bank(pool: DataFrame, spec: dict, workflow: bool = False) -> DataFrame:
    """Questions of a stored bank for a specification: approved ones only if the school validates; none if it can't be met."""
    return select_for_specification(approved_only(pool, workflow), spec)[0]


def fresh_first(candidates: DataFrame, used: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """n candidates, those not used before the others."""
    old = used.select(key).distinct().withColumn("_old", F.lit(1))
    return candidates.join(old, key, "left").orderBy(F.coalesce("_old", F.lit(0)), *order).limit(n).drop("_old")


def version_label(index: Column, letters: int = 4) -> Column:
    """A, B, ... Z, AA, ... for 0, 1, ..., with `letters` letters at most (475,253 labels for 4)."""
    out, rest = F.lit(""), index
    for _ in range(letters):
        letter = F.when(rest >= 0, F.chr((F.lit(65) + F.pmod(rest, F.lit(26))).cast("long"))).otherwise("")
        out, rest = F.concat(letter, out), F.floor(rest / 26) - 1
    return out


def label_index(label: Column, letters: int = 4) -> Column:
    """0, 1, ... for A, B, ...: the index that has this `version_label`, or null if none has."""
    digits = F.transform(F.split(label, ""), lambda x: F.ascii(x) - 64)
    return F.when(label.rlike(rf"\A[A-Z]{{1,{letters}}}\z"), F.aggregate(digits, F.lit(0), lambda a, x: a * 26 + x) - 1)


def next_label(versions: DataFrame, papers: DataFrame, key: str = "paper_id", label: str = "version_label") -> DataFrame:
    """The smallest unused label of each paper.

    Labels in use that are as many as the labels before them leave none free there. Nothing is listed or joined, so no
    list of labels is broadcast.
    """
    used = versions.where(F.col(key).isNotNull()).select(key, label_index(F.col(label)).alias("i"), F.lit(False).alias("asked"))
    rows = papers.select(key, F.lit(None).cast("int").alias("i"), F.lit(True).alias("asked")).unionByName(used)
    place = F.dense_rank().over(Window.partitionBy(key).orderBy(F.col("i").asc_nulls_last()))
    found = rows.withColumn("place", place).groupBy(key).agg(F.max("asked").alias("asked"), F.max(F.when(F.col("place") == F.col("i") + 1, F.col("place"))).alias("n"))
    return found.where("asked").select(key, version_label(F.coalesce("n", F.lit(0))).alias(label))


def section_bucket(kind: Column, marks: Column) -> Column:
    """Order number of a question's section: 1 mcq, 2 very short, 3 short, 4 long, 5 map."""
    return F.when(F.upper(kind).contains("MAP"), 5).when(F.upper(kind) == "MCQ", 1).when(marks <= 2, 2).when(marks <= 3.5, 3).otherwise(4)


def sections(questions: DataFrame, version: str = "version_id", position: str = "position") -> DataFrame:
    """Section letter and numbers of each question; letters only count sections that have questions."""
    q = questions.withColumn("bucket", section_bucket(F.col("question_type"), F.col("marks")))
    letters = Window.partitionBy(version).orderBy("bucket")
    q = q.withColumn("section", F.chr((F.lit(64) + F.dense_rank().over(letters)).cast("long")))
    return q.withColumn("number", F.row_number().over(Window.partitionBy(version).orderBy("bucket", position))).withColumn("number_in_section", F.row_number().over(Window.partitionBy(version, "bucket").orderBy(position)))


def admit(rows: DataFrame, group: list[str], order: list[str], capacity: Column) -> DataFrame:
    """`admitted` for the first rows of each group up to its capacity."""
    return rows.withColumn("admitted", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) <= capacity)


def import_students(rows: DataFrame, capacity: int | Column, school: str = "school_id", existing: DataFrame | None = None) -> DataFrame:
    """Outcome of each imported row: created, duplicate (of an accepted row by gr or phone) or over_limit, in file order.

    rows: (school, row, gr_number, phone, ...), rows of a school numbered without repeats; capacity: the seats that are
    left, or a column of rows that names them. existing: (school, gr_number, phone) of those who are there already: a gr
    counts in its school, a phone everywhere. Only accepted rows count as seen. Rows that share a gr or a phone are
    neighbours, and the accepted ones are the first that a walk over these keeps (`first_kept`), up to the capacity; so
    no school is walked in one task. Null and empty values are nobody's.
    """
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    base = materialize(rows.select(F.struct(F.col(school).alias("s"), F.col("row").alias("r")).alias("node"), given("gr_number").alias("gr"), given("phone").alias("phone"), (capacity if isinstance(capacity, Column) else F.lit(capacity)).cast("long").alias("seats")), "imported")
    taken = base.select("node").where("false")
    if existing is not None:
        grs = existing.select(F.col(school).alias("s"), given("gr_number").alias("gr")).where("gr is not null").distinct()
        phones = existing.select(given("phone").alias("phone")).where("phone is not null").distinct()
        taken = base.join(grs, (F.col("node.s") == grs["s"]) & (base["gr"] == grs["gr"]), "left_semi").select("node").unionByName(base.join(phones, "phone", "left_semi").select("node")).distinct()
    taken = materialize(taken, "taken")
    free = base.join(taken, "node", "left_anti")
    keys = free.select("node", F.explode(F.array(F.when(F.col("gr").isNotNull(), F.concat(F.lit("g"), "gr")), F.when(F.col("phone").isNotNull(), F.concat(F.lit("p"), "phone")))).alias("key")).where("key is not null")
    cliques = materialize(keys.select(F.to_json(F.struct(F.col("node.s").alias("s"), "key"), {"ignoreNullFields": "false"}).alias("clique"), "node"), "shared")
    kept = first_kept(free.select("node"), free.select(F.col("node").alias("later"), F.col("node").alias("earlier")).where("false"), cliques)
    ranked = kept.join(base.select("node", "seats"), "node").withColumn("n", F.row_number().over(Window.partitionBy("node.s").orderBy("node.r")))
    created = materialize(ranked.where("n <= seats").select("node"), "created")
    seen = cliques.join(created, "node").select("clique").distinct()
    again = cliques.join(seen, "clique", "left_semi").select("node").join(created, "node", "left_anti").unionByName(taken).distinct()
    outcome = created.select("node", F.lit("created").alias("outcome")).unionByName(again.select("node", F.lit("duplicate").alias("outcome")))
    keyed = rows.withColumn("_node", F.struct(F.col(school).alias("s"), F.col("row").alias("r")))
    out = keyed.join(outcome.withColumnRenamed("node", "_node"), "_node", "left")
    return out.select(*rows.columns, F.coalesce("outcome", F.lit("over_limit")).alias("outcome"))


def fill_budget(items: DataFrame, group: str, budget: int) -> DataFrame:
    """`kept` for items that fit a token budget, tried by priority; an item that does not fit is skipped, not the end.

    items: (group, position, priority, tokens), tokens not negative. Once an item is skipped, so are all later ones of its
    size or more; the kept items of a size are the first of it, at most budget / size. Only these are walked in order.
    """
    order = Window.partitionBy(group, "tokens").orderBy(F.col("priority").asc_nulls_last(), F.col("position").asc_nulls_last())
    rows = items.withColumn("_n", F.row_number().over(order))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        left, kept = budget, {}
        for t in pdf.sort_values(["priority", "position", "tokens"])["tokens"]:
            if t <= left:
                left -= t
                kept[t] = kept.get(t, 0) + 1
        return pd.DataFrame({"_group": [pdf[group].iloc[0]] * len(kept), "_tokens": list(kept), "_kept": list(kept.values())})

    tried = rows.where((F.col("tokens") > 0) & (F.col("_n") * F.col("tokens") <= budget)).select(group, "tokens", "priority", "position")
    kind = {f.name: f.dataType.simpleString() for f in items.schema}
    sizes = tried.groupBy(group).applyInPandas(fill, f"_group {kind[group]}, _tokens {kind['tokens']}, _kept long")
    joined = rows.join(sizes, F.col(group).eqNullSafe(F.col("_group")) & (F.col("tokens") == F.col("_tokens")), "left")
    kept = F.coalesce(((F.col("tokens") == 0) & F.lit(budget >= 0)) | (F.col("_n") <= F.col("_kept")), F.lit(False))
    return joined.select(*items.columns, kept.alias("kept"))
