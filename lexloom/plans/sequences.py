"""Queries over ordered rows and joins by place: users' events are lines, events their pieces."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gaps as G
from ..operators import ordering as O
from ..operators import sequences as S
from .registry import query
from .tables import ENTRIES, entries, table

MINUTE = 60_000_000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with us, microseconds since 1970 whatever the session's time zone."""
    return table(spark, sf_dir, "events").withColumn("us", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))"))


EVENTS = "ev AS (SELECT *, epoch_us(ts) AS us FROM events)"
LINE = "PARTITION BY user_id ORDER BY us, event_id"


@query("seq_number", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count_if(role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS n_user FROM conversations")
def seq_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = O.numbered(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"])
    return rows.select("conv_id", "turn", "n", F.count_if(F.col("role") == "user").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n_user"))


@query("gap_sessions", f"WITH {EVENTS}, g AS (SELECT user_id, us, event_id, sum(CASE WHEN gap > 36000000000 THEN 1 ELSE 0 END) OVER ({LINE} ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, us - lag(us) OVER ({LINE}) AS gap FROM ev)) SELECT user_id, s AS session, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM g GROUP BY user_id, s")
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.gap_groups(events(spark, sf_dir), ["user_id"], ["us", "event_id"], F.col("us"), F.lit(10 * 60 * MINUTE), "session")
    return rows.groupBy("user_id", "session").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("n"))


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = events(spark, sf_dir)
    gap = (F.col("us") - F.lag("us").over(Window.partitionBy("user_id").orderBy("us", "event_id"))) / MINUTE
    return rows.select("user_id", "event_type", gap.alias("gap"), F.lit(100.0).alias("height"))


def _thresholds(key: str) -> str:
    """SQL for the thresholds of each key's gaps in minutes, of a height of 100: (key, n_gaps, threshold, method, small_mode, large_mode, otsu)."""
    return f"""{EVENTS}, ga AS (SELECT {key}, (us - lag(us) OVER ({LINE})) / 60000000.0 AS gap FROM ev), gc AS (SELECT {key}, ln(gap) AS l, gap, count(*) AS c FROM ga WHERE gap >= 1 GROUP BY ALL),
    gs AS (SELECT {key}, sum(c) AS n, min(l) AS lo, max(l) AS hi FROM gc GROUP BY {key}), de AS (SELECT {key}, i, lo - 0.5 + i * (hi - lo + 1) / 399 AS x, sum(c * exp(-0.5 * pow((lo - 0.5 + i * (hi - lo + 1) / 399 - l) / 0.15, 2))) AS d FROM gs JOIN gc USING ({key}), range(400) t(i) GROUP BY ALL),
    pk AS (SELECT * FROM (SELECT *, lag(d) OVER w AS b, lead(d) OVER w AS a FROM de WINDOW w AS (PARTITION BY {key} ORDER BY i)) WHERE d > b AND d > a),
    pr AS (SELECT p.{key}, p.i AS i, q.i AS j, p.x AS xi, q.x AS xj, least(p.d, q.d) AS low FROM pk p JOIN pk q ON q.{key} = p.{key} AND q.x - p.x >= ln(2.0)),
    vl AS (SELECT pr.{key}, pr.i, pr.j, xi, xj, any_value(low) - min(de.d) AS depth, arg_min(de.x, (de.d, de.i)) AS xv FROM pr JOIN de ON de.{key} = pr.{key} AND de.i BETWEEN pr.i AND pr.j GROUP BY ALL),
    be AS (SELECT {key}, arg_max([xi, xj, xv], (depth, -i, -j)) AS x FROM vl WHERE depth > 0 GROUP BY {key}),
    hi AS (SELECT {key}, b, coalesce(sum(c), 0) AS c, any_value(lo) + (b + 0.5) * (any_value(hi) - any_value(lo)) / 256 AS m FROM (SELECT {key}, lo, hi, b FROM gs, range(256) t(b)) LEFT JOIN (SELECT {key}, least(255, floor((l - lo) * 256 / (hi - lo)))::BIGINT AS b, c FROM gc JOIN gs USING ({key})) USING ({key}, b) GROUP BY {key}, b),
    cu AS (SELECT *, sum(c) OVER w AS below, sum(c) OVER (PARTITION BY {key}) - sum(c) OVER w AS above, sum(c * m) OVER w AS sb, sum(c * m) OVER (PARTITION BY {key}) AS st FROM hi WINDOW w AS (PARTITION BY {key} ORDER BY b)),
    cv AS (SELECT {key}, b, m, below * above * pow(sb / greatest(below, 1) - (st - sb) / greatest(above, 1), 2) AS v FROM cu WHERE b < 255), ot AS (SELECT {key}, arg_min(m, b) AS m FROM (SELECT *, max(v) OVER (PARTITION BY {key}) AS most FROM cv) WHERE v >= most * (1 - 1e-9) GROUP BY {key}),
    sh AS (SELECT {key}, sum(c) AS over FROM gc JOIN be USING ({key}) WHERE gap > exp(x[3]) GROUP BY {key}),
    th AS (SELECT k.{key}, coalesce(n, 0) AS n_gaps, coalesce(n, 0) < 8 AS few, exp(m) AS cut, exp(x[1]) AS sm, exp(x[2]) AS lm, exp(x[3]) AS valley, x IS NOT NULL AS found, coalesce(over, 0) < 0.25 * n AS short
      FROM (SELECT DISTINCT {key} FROM ev) k LEFT JOIN gs USING ({key}) LEFT JOIN ot USING ({key}) LEFT JOIN be USING ({key}) LEFT JOIN sh USING ({key})),
    thresholds AS (SELECT {key}, n_gaps::INT AS n_gaps, CASE WHEN few THEN 30.0 WHEN NOT found OR short THEN cut ELSE valley END AS threshold, CASE WHEN few THEN 'few gaps' WHEN NOT found THEN 'otsu' WHEN short THEN 'otsu (few gaps above the valley)' ELSE 'valley' END AS method,
      CASE WHEN NOT few AND found AND NOT short THEN sm END AS small_mode, CASE WHEN NOT few AND found AND NOT short THEN lm END AS large_mode, CASE WHEN NOT few THEN cut END AS otsu FROM th)"""


@query("gap_valley", f"WITH {_thresholds('event_type')} SELECT event_type, n_gaps, round(threshold, 6) AS threshold, method, round(small_mode, 6) AS small_mode, round(large_mode, 6) AS large_mode, round(otsu, 6) AS otsu FROM thresholds")
def gap_valley(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold of each event type's gaps in minutes, from their density."""
    found = G.thresholds(_gaps(spark, sf_dir), ["event_type"], "gap", "height")
    return found.withColumns({c: F.round(c, 6) for c in ("threshold", "small_mode", "large_mode", "otsu")})


@query(
    "gap_valley_sessions",
    f"""WITH {_thresholds('user_id')}, q AS (SELECT ev.user_id, method, us, event_id, us - lag(us) OVER (PARTITION BY ev.user_id ORDER BY us, event_id) > threshold * 60000000 AS far FROM ev JOIN thresholds t ON t.user_id = ev.user_id)
    SELECT user_id, method, count_if(far) + 1 AS n_sessions, count(*) AS n FROM q GROUP BY user_id, method""",
)
def gap_valley_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user by the threshold of the user's own gaps."""
    found = G.thresholds(_gaps(spark, sf_dir), ["user_id"], "gap", "height").select("user_id", (F.col("threshold") * MINUTE).alias("limit"), "method")
    rows = S.gap_groups(events(spark, sf_dir).join(found, "user_id"), ["user_id"], ["us", "event_id"], F.col("us"), F.col("limit"), "session")
    return rows.groupBy("user_id", "method").agg((F.max("session") + 1).alias("n_sessions"), F.count("*").alias("n"))


@query(
    "gap_groups_2d",
    f"""WITH RECURSIVE {EVENTS}, p AS (SELECT user_id, us / 3600000000 AS x, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY us, value) AS i FROM ev),
    f AS (SELECT user_id, i, 0 AS g, [{{'x': x, 'y': y}}] AS m FROM p WHERE i = 1
      UNION ALL SELECT user_id, i, g + far::INT, CASE WHEN far THEN [{{'x': x, 'y': y}}] ELSE list_append(m, {{'x': x, 'y': y}}) END
        FROM (SELECT f.user_id, p.i, g, m, p.x, p.y, list_min(list_transform(m, lambda q: sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)))) > 20 AS far FROM f JOIN p ON p.user_id = f.user_id AND p.i = f.i + 1))
    SELECT user_id, max(g) + 1 AS n_groups, count(*) AS n FROM f GROUP BY user_id""",
)
def gap_groups_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", (F.col("us") / MINUTE / 60).alias("x"), F.col("value").alias("y"), "event_id")
    return S.gap_groups_2d(rows, ["user_id"], "x", "x", "y", 20.0).groupBy("user_id").agg((F.max("group_no") + 1).alias("n_groups"), F.count("*").alias("n"))


def saving(scores: np.ndarray) -> float:
    """The score of joined pieces in merge_fold: a tenth less than their sum, and 3 more."""
    return float(0.9 * scores.sum() + 3)


@query(
    "merge_fold",
    f"""WITH RECURSIVE {EVENTS}, p AS (SELECT user_id, us AS l, us + 300000000 AS r, coalesce(CASE WHEN event_type <> 'purchase' THEN value END, 'Infinity'::DOUBLE) AS s, row_number() OVER (PARTITION BY user_id ORDER BY us, us + 300000000, event_id) AS i FROM ev),
    f AS (SELECT user_id, i, 0 AS unit, l AS first, r AS last, 1 AS n, s AS total, s AS best FROM p WHERE i = 1
      UNION ALL SELECT user_id, i, unit + (NOT j)::INT, CASE WHEN j THEN first ELSE l END, CASE WHEN j THEN greatest(last, r) ELSE r END, CASE WHEN j THEN n + 1 ELSE 1 END, CASE WHEN j THEN total + s ELSE s END, CASE WHEN j THEN 0.9 * (total + s) + 3 ELSE s END
        FROM (SELECT f.user_id, p.i, unit, first, last, n, total, best, p.l, p.r, p.s, p.l - last < 36000000000 AND n < 3 AND 0.9 * (total + p.s) + 3 < best + p.s AS j FROM f JOIN p ON p.user_id = f.user_id AND p.i = f.i + 1))
    SELECT user_id, unit, arg_max(first, i) AS first, arg_max(last, i) AS last, max(n) AS n, CASE WHEN NOT isinf(arg_max(best, i)) THEN arg_max(best, i) END AS best FROM f GROUP BY user_id, unit""",
)
def merge_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", F.col("us").alias("left"), (F.col("us") + 5 * MINUTE).alias("right"), F.when(F.col("event_type") != "purchase", F.col("value")).alias("score"))
    return S.merge_fold(rows, ["user_id"], "left", "right", "score", saving, 600 * MINUTE)


@query(
    "entry_segments",
    """WITH n AS (SELECT conv_id, turn, text, role, count_if(role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS segment FROM conversations)
    SELECT conv_id, segment, arg_min(text, turn) AS head, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role <> 'user'), '') AS body, count(*) AS n FROM n WHERE segment > 0 GROUP BY conv_id, segment""",
)
def entry_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.segments(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn"], F.col("role") == "user", F.col("text"))


@query("ditto_fill", f"WITH {EVENTS} SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER ({LINE} ROWS UNBOUNDED PRECEDING) AS filled FROM ev")
def ditto_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_type") == "purchase", F.col("value"))
    return S.fill_forward(events(spark, sf_dir), ["user_id"], ["us", "event_id"], value, "filled").select("event_id", "filled")


@query("label_runs", f"WITH {EVENTS}, p AS (SELECT user_id, event_type, row_number() OVER ({LINE}) AS i, row_number() OVER ({LINE}) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) AS r FROM ev) SELECT user_id, event_type, min(i) AS first, max(i) AS last, count(*) AS n FROM p GROUP BY user_id, event_type, r")
def label_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.runs(events(spark, sf_dir).select("user_id", "us", "event_id", "event_type"), ["user_id"], ["us", "event_id"], "event_type")


_DAYS = f"{EVENTS}, d AS (SELECT DISTINCT user_id, (us // 86400000000)::INT AS day FROM ev)"


@query("active_stretches", f"WITH {_DAYS}, m AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY user_id ORDER BY day) - 1 > 1 THEN 1 ELSE 0 END AS x FROM d), r AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS r FROM m) SELECT user_id, min(day) AS first, max(day) AS last FROM r GROUP BY user_id, r HAVING max(day) - min(day) + 1 >= 3")
def active_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = events(spark, sf_dir).select("user_id", F.floor(F.col("us") / 86_400_000_000).cast("int").alias("day")).distinct()
    return S.interval_runs(days, ["user_id"], "day", F.lit(True), 3, 1)


@query("neighbour_class", f"WITH {EVENTS}, n AS (SELECT event_id, event_type, lag(event_type) OVER ({LINE}) AS b, lead(event_type) OVER ({LINE}) AS a FROM ev) SELECT event_id, CASE WHEN b IS NULL THEN 'first' WHEN a IS NULL THEN 'last' WHEN a = b AND b <> event_type THEN 'isolated' ELSE event_type END AS kind FROM n")
def neighbour_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.neighbour_kinds(events(spark, sf_dir), ["user_id"], ["us", "event_id"], "event_type", "kind")
    return rows.select("event_id", "kind")


@query(
    "smoothed_labels",
    """WITH t AS (SELECT conv_id, turn, [role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn)] AS x FROM conversations), l AS (SELECT conv_id, list(x ORDER BY turn) AS xs FROM t GROUP BY conv_id)
    SELECT conv_id, array_to_string(list_reduce(xs, lambda a, x: list_append(a, CASE WHEN len(a) > 0 AND x[2] IS NOT NULL AND a[len(a)] = x[2] AND x[1] <> x[2] THEN x[2] ELSE x[1] END), []::VARCHAR[]), ',') AS smoothed FROM l""",
)
def smoothed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns' roles of each conversation with isolated ones smoothed, left to right."""
    roles = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    labels = F.transform("r", lambda x: x["role"])
    return roles.select("conv_id", F.array_join(S.smooth_labels(labels), ",").alias("smoothed"))


@query(
    "page_tracker",
    """WITH l AS (SELECT conv_id, list([length(text) % 40, (role = 'user')::INT] ORDER BY turn) AS xs FROM conversations GROUP BY conv_id),
    p AS (SELECT conv_id, list_reduce(xs, lambda a, x: list_append(a, CASE WHEN x[2] = 0 THEN a[len(a)] WHEN x[1] > a[len(a)] AND x[1] <= a[len(a)] + 3 THEN x[1] ELSE a[len(a)] + 1 END), [1]::BIGINT[]) AS a FROM l)
    SELECT conv_id, a[2:]::INT[] AS pages FROM p""",
)
def page_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page numbers along each conversation, read as the length of a turn modulo 40; user turns are page heads."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", (F.length("text") % 40).alias("n"), (F.col("role") == "user").alias("h")))).alias("r"))
    return rows.select("conv_id", S.page_numbers(F.transform("r", lambda x: x["n"]), F.transform("r", lambda x: x["h"])).alias("pages"))


@query("close_runs", f"WITH {EVENTS}, e AS (SELECT user_id, us AS l, us + 3600000000 AS r, event_id FROM ev), m AS (SELECT *, max(r) OVER (PARTITION BY user_id ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS edge FROM e), n AS (SELECT *, sum(CASE WHEN edge IS NULL OR l - edge > 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY l, r ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT user_id, min(l) AS l, max(r) AS r, count(*) AS n FROM n GROUP BY user_id, run HAVING count(*) >= 4")
def close_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", F.col("us").alias("l"), (F.col("us") + 60 * MINUTE).alias("r"))
    return S.close_runs(rows, ["user_id"], "l", "r", F.lit(120 * MINUTE), 4).select("user_id", "l", "r", "n")


@query(
    "alphabetical_heads",
    f"""WITH {ENTRIES}, l AS (SELECT source, list([left(headword, 1)] ORDER BY ord) AS xs FROM entries GROUP BY source)
    SELECT source, len(list_reduce(xs, lambda a, x: CASE WHEN len(a) = 0 OR (x[1] >= list_min(a[-5:]) AND ascii(x[1]) <= ascii(list_max(a[-5:])) + 4) THEN list_append(a, x[1]) ELSE a END, []::VARCHAR[])) AS n FROM l""",
)
def alphabetical_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many heads of each source are in alphabetical order as far as the last accepted ones tell."""
    rows = entries(spark, sf_dir).select("source", "ord", "headword")
    return S.in_alphabetical_order(rows, ["source"], "ord", "headword").groupBy("source").agg(F.count("*").alias("n"))


@query(
    "text_lines",
    f"""WITH RECURSIVE {EVENTS}, p AS (SELECT user_id, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY value, us) AS i FROM ev),
    f AS (SELECT user_id, i, 0 AS line, y AS mean, 1 AS n FROM p WHERE i = 1
      UNION ALL SELECT f.user_id, p.i, line + (abs(p.y - mean) > 5)::INT, CASE WHEN abs(p.y - mean) > 5 THEN p.y ELSE mean + (p.y - mean) / (n + 1) END, CASE WHEN abs(p.y - mean) > 5 THEN 1 ELSE n + 1 END FROM f JOIN p ON p.user_id = f.user_id AND p.i = f.i + 1)
    SELECT user_id, max(line) + 1 AS n_lines, count(*) AS n FROM f GROUP BY user_id""",
)
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user clustered into lines by their value."""
    rows = events(spark, sf_dir).select("user_id", F.col("us").alias("x"), F.col("value").alias("y"), "event_id")
    return S.text_lines(rows, ["user_id"], "x", "y", 5.0).groupBy("user_id").agg((F.max("line_no") + 1).alias("n_lines"), F.count("*").alias("n"))


@query(
    "nearest_assign",
    f"""WITH {EVENTS}, t AS (SELECT user_id, us AS pos, min(event_id) AS id FROM ev WHERE event_type = 'purchase' GROUP BY user_id, us), c AS (SELECT e.event_id, t.id, abs(e.us - t.pos) AS d, t.pos FROM ev e LEFT JOIN t ON t.user_id = e.user_id)
    SELECT event_id, CASE WHEN min(d) <= 3600000000 * 6 THEN arg_min(id, (d, pos)) END AS target, CASE WHEN min(d) <= 3600000000 * 6 THEN min(d)::DOUBLE END AS distance FROM c GROUP BY event_id""",
)
def nearest_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "user_id", "us", "event_type")
    marks = rows.where("event_type = 'purchase'").select("user_id", F.col("us").alias("at"), F.col("event_id").alias("id"))
    return S.nearest(rows, marks, "user_id", "us", "at", "id", 6.0 * 60 * MINUTE).select("event_id", "target", "distance")


@query("page_map_join", "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN n_nationkey * 10 + n_regionkey ELSE n_nationkey + 7 END AS mapped FROM nation")
def page_map_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    exceptions = nation.where("n_nationkey < 5").select("n_nationkey", (F.col("n_nationkey") * 10 + F.col("n_regionkey")).alias("v"))
    return S.mapped_with_offset(nation.select("n_nationkey"), exceptions, "n_nationkey", "v", 7)


@query("anti_done", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000)")
def anti_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that have no large finished order yet."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


@query("integrity_orphans", "SELECT 'orders.o_custkey' AS rule, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'lineitem.l_orderkey', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'labels.doc_id', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def integrity_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("labels", "doc_id", "documents", "doc_id")]
    out = None
    for child, key, parent, parent_key in rules:
        known = table(spark, sf_dir, parent).select(F.col(parent_key).alias("__k"))
        lost = table(spark, sf_dir, child).select(F.col(key).alias("__k")).join(known, "__k", "left_anti").agg(F.lit(f"{child}.{key}").alias("rule"), F.count("*").alias("n"))
        out = lost if out is None else out.unionByName(lost)
    return out


@query(
    "exact_set_join",
    """WITH a AS (SELECT l_orderkey AS k, string_agg(DISTINCT l_suppkey::VARCHAR, '+' ORDER BY l_suppkey::VARCHAR) AS s FROM lineitem GROUP BY l_orderkey)
    SELECT x.k AS a, min(y.k) AS b FROM a x JOIN a y ON x.s = y.s AND x.k <> y.k GROUP BY x.k""",
)
def exact_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), "+").alias("s"))
    # the two smallest members of each set of copies answer for all of them, so a common set needs no join with itself
    firsts = sets.groupBy("s").agg(F.min("k").alias("k1"), F.count("*").alias("n")).where("n > 1")
    seconds = sets.join(firsts, "s").where("k > k1").groupBy("s").agg(F.min("k").alias("k2"))
    return sets.join(firsts, "s").join(seconds, "s").select(F.col("k").alias("a"), F.when(F.col("k") == F.col("k1"), F.col("k2")).otherwise(F.col("k1")).alias("b"))


@query("paired_places", "WITH o AS (SELECT l_orderkey AS k, list(l_linenumber ORDER BY l_linenumber) FILTER (WHERE l_returnflag = 'N') AS a, list(l_linenumber ORDER BY l_linenumber) FILTER (WHERE l_returnflag = 'R') AS b FROM lineitem GROUP BY l_orderkey), z AS (SELECT k, unnest(a) AS x, unnest(b) AS y FROM o WHERE len(a) = len(b)) SELECT * FROM z")
def paired_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = lambda f: F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == f, F.col("l_linenumber"))))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(places("N").alias("x"), places("R").alias("y"))
    return rows.where("size(x) = size(y) AND size(x) > 0").select("k", F.inline(F.arrays_zip("x", "y")))


@query(
    "width_batches",
    """WITH RECURSIVE p AS (SELECT source, n_chars AS w, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS i FROM documents),
    f AS (SELECT source, i, 0 AS batch, 1 AS size, w AS widest FROM p WHERE i = 1
      UNION ALL SELECT source, i, batch + c::INT, CASE WHEN c THEN 1 ELSE size + 1 END, CASE WHEN c THEN w ELSE greatest(w, widest) END
        FROM (SELECT f.source, p.i, batch, size, widest, w, size >= 16 OR (size + 1) * greatest(widest, w) > 60000 AS c FROM f JOIN p ON p.source = f.source AND p.i = f.i + 1))
    SELECT source, max(batch) + 1 AS n_batches, count(*) AS n FROM f GROUP BY source""",
)
def width_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return O.width_batches(rows, ["source"], "doc_id", "n_chars", 16, 60_000).groupBy("source").agg((F.max("batch") + 1).alias("n_batches"), F.count("*").alias("n"))


_POOL = "pool::VARCHAR || '/' || batch::VARCHAR"


def _uniform(key: str, seed: int | str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || ({key})::VARCHAR), 1, 13))::BIGINT / {2**52}::DOUBLE)"


@query("bucketed_batches", f"WITH p AS (SELECT doc_id, n_chars, floor({_uniform('doc_id', 0)} * greatest(1, ceil((SELECT count(*) FROM documents) / 128)))::BIGINT AS pool FROM documents), b AS (SELECT doc_id, pool, (row_number() OVER (PARTITION BY pool ORDER BY n_chars, doc_id) - 1) // 16 AS batch FROM p) SELECT *, {_uniform(_POOL, 1)} AS place FROM b")
def bucketed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.bucketed_batches(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 16, 8)


@query("seeded_sample", f"SELECT doc_id, source FROM documents ORDER BY {_uniform('doc_id', 7)}, doc_id LIMIT 100")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 100 documents without replacement."""
    return O.sample(table(spark, sf_dir, "documents").select("doc_id", "source"), F.col("doc_id"), 100, 7)


@query(
    "weighted_sample",
    f"""WITH r AS (SELECT doc_id, n_chars::DOUBLE AS w, floor({_uniform('doc_id', 'bucket')} * 256) AS bucket FROM documents WHERE n_chars > 0),
    l AS (SELECT doc_id, w, sum(w) OVER (ORDER BY bucket, doc_id) AS hi FROM r), d AS (SELECT range AS draw, {_uniform('range', 7)} * (SELECT sum(w) FROM r) AS u FROM range(100))
    SELECT draw, doc_id FROM d JOIN l ON u >= hi - w AND u < hi""",
)
def weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 draws of documents with replacement, in proportion to their lengths."""
    return O.weighted_sample(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 100, 7)
