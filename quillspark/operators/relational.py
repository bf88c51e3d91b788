"""Filters, scopes, sorts, pages and counts over question-bank tables. Each operator is DataFrame to DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Status values that wait for a validator (fixed values).
QUEUE = ("SUBMITTED", "UNDER_VALIDATION", "CORRECTION_REQUIRED")
ITEM_TYPES = ("PARAGRAPH", "HEADING", "FORMULA", "DEFINITION", "EXAMPLE", "TABLE", "IMAGE", "EXERCISE")


def given(value) -> bool:
    """Whether a filter parameter asks for anything: empty, missing and ALL don't."""
    return value is not None and str(value).strip() != "" and str(value).upper() != "ALL"


def contains(column: Column | str, text: str) -> Column:
    """Case-insensitive substring test; % and _ are plain characters."""
    escaped = text.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
    return F.col(column).ilike(f"%{escaped}%") if isinstance(column, str) else column.ilike(f"%{escaped}%")


def search(columns: list[str], text: str) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(contains(c, text.strip()), F.lit(False)) for c in columns])


def web_search(column: str, query: str) -> Column:
    """Words that must all occur, `-word` that must not, quoted phrases, and `or` between alternatives (no stemming)."""
    import re

    tokens = F.filter(F.split(F.lower(F.col(column)), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 0)
    ways: list[Column] = []
    for part in re.split(r"\s+or\s+", query, flags=re.I):
        terms = [
            F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).contains(f" {' '.join(re.findall(r'\w+', phrase.lower()))} ") if phrase else (~F.array_contains(tokens, word[1:].lower()) if word[0] == "-" else F.array_contains(tokens, word.lower()))
            for phrase, word in re.findall(r'"([^"]+)"|(-?\w+)', part)
        ]
        if terms:
            ways.append(reduce(lambda a, b: a & b, terms))
    return reduce(lambda a, b: a | b, ways) if ways else F.lit(True)


def filter_rows(df: DataFrame, params: dict, equal: dict[str, str] | None = None, fold: dict[str, str] | None = None, decimals: dict[str, str] | None = None, searched: list[str] | None = None) -> DataFrame:
    """AND of the given parameters; parameters that nothing names are ignored.

    equal: parameter to column compared in upper case; fold: compared without case; decimals: compared as DECIMAL(5,2),
    and skipped if the value is no number; searched: columns of the `search` (or `q`) parameter.
    """
    for p, c in (equal or {}).items():
        if given(params.get(p)):
            df = df.where(F.col(c) == str(params[p]).upper())
    for p, c in (fold or {}).items():
        if given(params.get(p)):
            df = df.where(F.lower(c) == str(params[p]).lower())
    for p, c in (decimals or {}).items():
        if params.get(p) not in (None, ""):
            value = F.lit(str(params[p])).try_cast("decimal(5,2)")
            df = df.where(value.isNull() | (F.col(c).cast("decimal(5,2)") == value))
    text = params.get("search") or params.get("q")
    if searched and text and text.strip():
        df = df.where(search(searched, text))
    return df


def topic_filter(questions: DataFrame, bridge: DataFrame, topics: str | list[int], key: str = "id", direct: str = "topic_id") -> DataFrame:
    """Questions of any of the topics, by their own topic or through the bridge; no row comes twice."""
    ids = [int(t) for t in topics.split(",") if t.strip().isdigit()] if isinstance(topics, str) else [int(t) for t in topics]
    linked = bridge.where(F.col("topic_id").isin(ids)).select(F.col("question_id").alias("_q")).distinct().withColumn("_hit", F.lit(True))
    joined = questions.join(linked, questions[key] == linked["_q"], "left")
    return joined.where(F.col("_hit") | F.col(direct).isin(ids)).drop("_q", "_hit")


def sort_rows(df: DataFrame, key: str | None, created: str = "created_at", ident: str = "id", marks: str = "marks", text: str = "question_text", difficulty: str = "difficulty", levels: tuple = ("EASY", "MEDIUM", "HARD")) -> DataFrame:
    """Named orders of a question list; an unknown or missing key is `newest`."""
    newest = [F.col(created).desc(), F.col(ident).desc()]
    weight = rank(F.col(difficulty), levels, 2)
    reverse = rank(F.col(difficulty), levels[::-1], 2)
    orders = {
        "newest": newest, "-created_at": newest, "oldest": [F.col(created).asc(), F.col(ident).asc()], "created_at": [F.col(created).asc(), F.col(ident).asc()],
        "marks_desc": [F.col(marks).desc(), *newest], "-marks": [F.col(marks).desc(), *newest], "marks_asc": [F.col(marks).asc(), *newest], "marks": [F.col(marks).asc(), *newest],
        "difficulty_asc": [weight.asc(), *newest], "difficulty_desc": [reverse.asc(), *newest], "text_asc": [F.col(text).asc(), F.col(ident).desc()], "question_text": [F.col(text).asc(), F.col(ident).desc()],
    }
    return df.orderBy(*orders.get((key or "").strip().lower(), newest))


def rank(column: Column, values: tuple, default: int) -> Column:
    out = F.when(F.lit(False), 0)
    for i, v in enumerate(values, 1):
        out = out.when(column == v, i)
    return out.otherwise(default)


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20, most: int = 100) -> DataFrame:
    """One page of a total order; sizes over `most` are cut to it."""
    size = max(1, min(size, most))
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def tenant_scope(is_super: bool, school: int | str | None, source: Column, owner: Column) -> Column:
    """Rows a user may see: all for a super user, shared and own for a school user, else shared ones."""
    if is_super:
        return F.lit(True)
    shared = F.coalesce(source == "GLOBAL", F.lit(False))
    return shared | F.coalesce(owner == school, F.lit(False)) if school is not None else shared


def user_scope(user: dict, school: str = "school_id", creator: str = "created_by_id", role: str = "role", ident: str = "id") -> Column:
    """Users that `user` may list: all without a school, the school with a school-wide role, own students for a teacher, else only itself."""
    if user.get("school_id") is None:
        return F.lit(True)
    own = F.col(school) == user["school_id"]
    if user.get("school_wide"):
        return own
    if user.get("role") == "Teacher":
        return own & ((F.col(creator) == user["id"]) | (F.col(role) == "Student"))
    return F.col(ident) == user["id"]


def paper_scope(user: dict, school: str = "school_id", creator: str = "created_by_id") -> Column:
    if user.get("school_id") is None and user.get("super"):
        return F.lit(True)
    if user.get("school_wide"):
        return F.col(school) == user["school_id"]
    return F.col(creator) == user["id"] if user.get("role") == "Teacher" else F.lit(False)


def delivery_scope(deliveries: DataFrame, assigned: DataFrame, user: dict) -> DataFrame:
    """Deliveries of papers in scope, or for a student those assigned to them."""
    if user.get("role") == "Student":
        mine = assigned.where(F.col("user_id") == user["id"]).select(F.col("delivery_id").alias("id"))
        return deliveries.join(mine, "id", "left_semi")
    return deliveries.where(paper_scope(user))


def approved_only(df: DataFrame, workflow: bool, status: str = "validation_status") -> DataFrame:
    return df.where(F.col(status) == "APPROVED") if workflow else df


def validation_queue(df: DataFrame, status: str | None = None, column: str = "validation_status") -> DataFrame:
    if status in ("ALL", "ALL_STATUSES"):
        return df
    return df.where(F.col(column) == status.upper()) if status else df.where(F.col(column).isin(*QUEUE))


def with_capability(users: DataFrame, grants: DataFrame, capability: str, absent: bool = False) -> DataFrame:
    """Users with (or without) a capability."""
    who = grants.where(F.col("capability") == capability).select(F.col("user_id").alias("id"))
    return users.join(who, "id", "left_anti" if absent else "left_semi")


def role_or_capability(users: DataFrame, grants: DataFrame, roles: list[str], needs: str, lacks: str | None = None, in_school: bool = False) -> DataFrame:
    """Users of the roles, or who hold a capability (and a school, and not another capability, if asked)."""
    held = grants.groupBy(F.col("user_id").alias("id")).agg(F.collect_set("capability").alias("_held"))
    has = lambda c: F.coalesce(F.array_contains("_held", c), F.lit(False))
    by_grant = has(needs)
    if in_school:
        by_grant = by_grant & F.col("school_id").isNotNull()
    if lacks:
        by_grant = by_grant & ~has(lacks)
    return users.join(held, "id", "left").where(F.col("role").isin(roles) | by_grant).drop("_held")


def audit_filter(category: str, action: str = "action") -> Column:
    low = F.lower(action)
    tests = {"PROCTORING": low.contains("proctoring"), "EXAMS": low.startswith("exam."), "PAPERS": low.startswith("paper."), "USERS": low.startswith("user.")}
    return tests.get(category.upper(), F.lit(True))


def open_window(start: Column, end: Column, now: Column) -> Column:
    """start <= now <= end, where a null side is open."""
    return F.coalesce(start <= now, F.lit(True)) & F.coalesce(now <= end, F.lit(True))


def retained(df: DataFrame, days: int, as_of: Column, time: str = "timestamp", action: str | None = None, column: str = "action") -> DataFrame:
    """Rows that a pruning run keeps: newer than the cutoff, or of another action."""
    old = F.col(time) < as_of - F.make_interval(days=F.lit(days))
    if action:
        old = old & (F.col(column) == action)
    return df.where(~F.coalesce(old, F.lit(False)))


def item_type(column: Column) -> Column:
    return F.when(F.upper(column).isin(*ITEM_TYPES), F.upper(column)).otherwise("PARAGRAPH")


def first_text(*columns: Column) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def rescue_pages(pages: DataFrame, cap: int = 20) -> DataFrame:
    """The first `cap` pages of each job that need another look."""
    weak = (F.col("quality") < 0.85) | F.col("needs_review") | (F.trim(F.coalesce("raw_text", F.lit(""))) == "") | F.array_contains("flags", "corrupted_formula_detected")
    w = Window.partitionBy("job_id").orderBy("page_number")
    return pages.where(~F.col("page_kind").isin("image_only", "blank") & F.coalesce(weak, F.lit(False))).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def ordered_lookup(ids: list[int], table: DataFrame, key: str) -> DataFrame:
    """Rows in the order of a request; ids without a row are left out."""
    wanted = table.sparkSession.createDataFrame([(i, v) for i, v in enumerate(ids)], f"position int, {key} long")
    return table.join(F.broadcast(wanted), key).orderBy("position")


def first_range(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, order: list[str], keys: list[str], group: list[str] | None = None) -> DataFrame:
    """Each point with the first range (in `order`) that holds it, or nulls. group: columns that must be equal.

    The axis is cut into buckets as wide as a range is on average, so ranges are in two buckets each on average, and
    points only meet the ranges of their own bucket.
    """
    group = group or []
    width = ranges.agg(F.avg(F.col(high) - F.col(low))).first()[0]
    width = float(width) if width and width > 0 else 1.0
    bucket = lambda c: F.floor(F.col(c) / width)
    listed = ranges.where(F.col(low) <= F.col(high)).select(*ranges.columns, F.explode(F.sequence(bucket(low), bucket(high))).alias("_b"))
    hit = F.struct(*(F.col(f"_r.{c}") for c in [*order, *(c for c in ranges.columns if c not in order)]))
    packed = listed.select("_b", *(F.col(g).alias(f"_g_{g}") for g in group), F.struct(*ranges.columns).alias("_r"))
    on = [F.col("_p") == F.col("_b"), *(points[g] == F.col(f"_g_{g}") for g in group), F.col(point).between(F.col(f"_r.{low}"), F.col(f"_r.{high}"))]
    joined = points.withColumn("_p", bucket(point)).join(packed, reduce(lambda a, b: a & b, on), "left")
    return joined.groupBy(*keys).agg(F.min(F.when(F.col("_r").isNotNull(), hit)).alias("hit"))


def child_counts(parents: DataFrame, children: DataFrame, key: str, child_key: str, aggregates: list[Column]) -> DataFrame:
    """Aggregates of the children of each parent; parents without children stay. Children are counted before the join."""
    counted = children.groupBy(F.col(child_key).alias(key)).agg(*aggregates)
    return parents.select(key).join(counted, key, "left").na.fill(0)


def union_distinct(constants: list[str], values: DataFrame) -> DataFrame:
    """(value, position): the constants in order, then new values by name."""
    spark = values.sparkSession
    first = spark.createDataFrame([(v, i) for i, v in enumerate(constants)], "value string, position int")
    rest = values.toDF("value").distinct().join(first, "value", "left_anti").withColumn("position", F.lit(len(constants)))
    return first.unionByName(rest)


def changed(a: Column, b: Column) -> Column:
    """Whether two arrays differ as sets."""
    return (F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0)


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule (a null outcome passes), with the names of the broken rules."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(True)), name) for name, ok in rules.items())), lambda x: x.isNotNull())
    return df.withColumn("broken", broken).where(F.size("broken") > 0)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; ties go to the larger row."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max(F.struct(*(F.col(c) for c in [*order, *(c for c in rest if c not in order)]))).alias("_row")
    return df.groupBy(*keys).agg(pick).select(*keys, "_row.*").select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key; the rest stays."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)
