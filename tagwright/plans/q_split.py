"""Registered queries: stratified split and class balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagwright import constants as K
from tagwright.operators import balance as B, split as SP
from tagwright.plans import fixtures as fx, oracle as O
from tagwright.plans.registry import register


def labeled(spark, sf):
    """The purged labelled set: custom_id, message, class (class != -1); one row in 53 has lost its class."""
    lost = F.when(F.col("doc_id") % 53 != 7, F.col("class"))
    return fx.gold(spark, sf).where(F.col("class") != K.UNLABELED).select("custom_id", "message", lost.alias("class"))


def split_df(spark, sf):
    return SP.stratified_split(labeled(spark, sf))


def train_df(spark, sf):
    return split_df(spark, sf).where(F.col("split") == "train").select("custom_id", "message", "class")


LABELED = f"SELECT custom_id, message, CASE WHEN doc_id % 53 <> 7 THEN class END AS class FROM ({O.GOLD}) g WHERE class <> -1"


def _approx(src: str, n: str, draws: str, out: str) -> str:
    """Largest-remainder allocation in SQL (twin of operators.split.approximate_mode)."""
    return (f"SELECT * EXCLUDE (cont, fl, rem, need), fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, class) <= need "
            f"THEN 1 ELSE 0 END AS {out} FROM (SELECT *, cont - fl AS rem, {draws} - sum(fl) OVER () AS need FROM ("
            f"SELECT *, CAST(floor(cont) AS BIGINT) AS fl FROM (SELECT *, CAST({n} AS DOUBLE) / CAST(sum({n}) OVER () AS DOUBLE) "
            f"* CAST({draws} AS DOUBLE) AS cont FROM ({src}) s0) s1) s2) s3")


def quotas_sql(src: str) -> str:
    counts = f"SELECT class, count(*) AS n FROM ({src}) x WHERE class IS NOT NULL GROUP BY class"
    q1 = (f"SELECT class, n, CAST(sum(n) OVER () - CAST(ceil(0.2::DOUBLE * sum(n) OVER ()) AS BIGINT) AS BIGINT) AS keep1 "
          f"FROM ({counts}) c")
    a1 = _approx(q1, "n", "keep1", "train1")
    q2 = f"SELECT class, n, n - train1 AS n_test, train1 AS m FROM ({a1}) a"
    q3 = f"SELECT *, CAST(sum(m) OVER () - CAST(ceil(0.125::DOUBLE * sum(m) OVER ()) AS BIGINT) AS BIGINT) AS keep2 FROM ({q2}) b"
    a2 = _approx(q3, "m", "keep2", "n_train")
    return f"SELECT class, n, n_test, m - n_train AS n_validation, n_train FROM ({a2}) z"


def h_sql(key: str, tag: str = "") -> str:
    return f"md5('{K.SPLIT_SEED}:{tag + ':' if tag else ''}' || CAST({key} AS VARCHAR))"


def split_sql(src: str) -> str:
    ranked = f"SELECT *, row_number() OVER (PARTITION BY class ORDER BY {h_sql('custom_id')}, custom_id) - 1 AS rk FROM ({src}) s"
    return (f"SELECT r.custom_id, r.message, r.class, CASE WHEN r.class IS NULL THEN 'quarantine' WHEN rk < q.n_test THEN 'test' WHEN rk < q.n_test + q.n_validation "
            f"THEN 'validation' ELSE 'train' END AS split FROM ({ranked}) r LEFT JOIN ({quotas_sql(src)}) q ON r.class = q.class")


SPLIT = split_sql(LABELED)
TRAIN = f"SELECT custom_id, message, class FROM ({SPLIT}) s WHERE split = 'train'"


@register("split_quotas", quotas_sql(LABELED))
def q_split_quotas(spark, sf):
    return SP.split_quotas(labeled(spark, sf).where(F.col("class").isNotNull()))


@register("stratified_split", f"SELECT custom_id, class, split FROM ({SPLIT}) s")
def q_stratified_split(spark, sf):
    return split_df(spark, sf).select("custom_id", "class", "split")


@register("split_distribution", f"""
SELECT split, class, n, CAST(n AS DOUBLE) * 100 / CAST(sum(n) OVER (PARTITION BY split) AS DOUBLE) AS pct FROM (
  SELECT split, class, count(*) AS n FROM ({SPLIT}) s GROUP BY 1, 2
  UNION ALL SELECT 'original', class, count(*) FROM ({SPLIT}) s GROUP BY 2) t
""")
def q_split_distribution(spark, sf):
    return SP.split_distribution(split_df(spark, sf))


@register("split_integrity", f"""
SELECT (SELECT count(*) FROM ({LABELED}) a) AS n_input, count(*) AS n_split_rows,
  count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'validation') AS n_validation,
  count(*) FILTER (WHERE split = 'test') AS n_test, count(*) FILTER (WHERE split = 'quarantine') AS n_quarantine,
  (SELECT count(*) FROM ({LABELED}) a WHERE custom_id NOT IN (SELECT custom_id FROM ({SPLIT}) b)) AS missing,
  (SELECT count(*) FROM (SELECT custom_id FROM ({SPLIT}) c GROUP BY 1 HAVING count(*) > 1) d) AS duplicated
FROM ({SPLIT}) s
""")
def q_split_integrity(spark, sf):
    return SP.split_integrity(labeled(spark, sf), split_df(spark, sf))


WEIGHTS = (f"SELECT class, n, CAST(sum(n) OVER () AS DOUBLE) / (CAST(n AS DOUBLE) * count(*) OVER ()) AS weight "
           f"FROM (SELECT class, count(*) AS n FROM ({TRAIN}) t GROUP BY 1) c")


@register("class_weights", WEIGHTS)
def q_class_weights(spark, sf):
    return B.class_weights(train_df(spark, sf))


@register("attach_class_weight", f"SELECT t.custom_id, t.class, w.weight FROM ({TRAIN}) t LEFT JOIN ({WEIGHTS}) w ON t.class = w.class")
def q_attach_class_weight(spark, sf):
    # the training classes' counts are quotas of the split: weights need no second pass over it
    counts = SP.split_quotas(labeled(spark, sf).where(F.col("class").isNotNull())).select("class", F.col("n_train").alias("n"))
    return B.attach_class_weight(train_df(spark, sf), B.weights_from_counts(counts)).select("custom_id", "class", "weight")


def unit_sql(h: str) -> str:
    return f"(('0x' || substr({h}, 1, 13))::UBIGINT::BIGINT / 4503599627370496.0::DOUBLE)"


RESAMPLE = f"""
WITH c AS (SELECT class, n_c, row_number() OVER (ORDER BY class) - 1 AS ci, count(*) OVER () AS k
           FROM (SELECT class, count(*) AS n_c FROM ({TRAIN}) t GROUP BY 1) x),
d AS (SELECT range AS i, {unit_sql(h_sql('range', 'r1'))} AS u1, {unit_sql(h_sql('range', 'r2'))} AS u2
      FROM range((SELECT count(*) FROM ({TRAIN}) t))),
p AS (SELECT c.class, CAST(floor(d.u2 * c.n_c) AS BIGINT) AS rk, count(*) AS draws FROM d JOIN c ON floor(d.u1 * c.k) = c.ci GROUP BY 1, 2),
r AS (SELECT custom_id, class, row_number() OVER (PARTITION BY class ORDER BY {h_sql('custom_id', 'resample')}, custom_id) - 1 AS rk
      FROM ({TRAIN}) t)
SELECT r.custom_id, r.class, p.draws FROM r JOIN p ON r.class = p.class AND r.rk = p.rk
"""


@register("balanced_resample", RESAMPLE)
def q_balanced_resample(spark, sf):
    return B.balanced_resample(train_df(spark, sf))


@register("shuffle_rows", f"""
SELECT custom_id, class, row_number() OVER (ORDER BY {h_sql('custom_id', 'epoch0')}, custom_id) - 1 AS position FROM ({TRAIN}) t
""")
def q_shuffle_rows(spark, sf):
    return B.shuffle_rows(train_df(spark, sf).select("custom_id", "class"))


_WEIGHTED = f"SELECT custom_id, CAST(round(length(message) / 1000.0::DOUBLE * 1000000) AS BIGINT) AS u FROM ({TRAIN}) t"


@register("weighted_draws", f"""
WITH d AS (SELECT * FROM ({_WEIGHTED}) w WHERE u > 0),
r AS (SELECT custom_id, u, sum(u) OVER (ORDER BY {h_sql('custom_id', 'weighted')}, custom_id) AS hi FROM d),
n AS (SELECT count(*) AS n, sum(u)::HUGEINT AS total FROM d),
x AS (SELECT (('0x' || substr({h_sql('i', 'weighted-draw')}, 1, 13))::UBIGINT::HUGEINT * total) // 4503599627370496 AS t
      FROM n, unnest(range(n)) g(i))
SELECT custom_id, count(*) AS draws FROM x JOIN r ON t >= hi - u AND t < hi GROUP BY custom_id
""")
def q_weighted_draws(spark, sf):
    """As many draws as training rows, each row by the length of its message."""
    return B.weighted_draws(train_df(spark, sf), F.length("message") / 1000.0)


def _permute_sql(src: str) -> str:
    """One pass of the Feistel network over column x of a table (custom_id, x, n, a, b): a rows, b columns."""
    hashed = lambda r, v: f"('0x' || substr(md5('{K.SPLIT_SEED}:epoch0:{r}:' || {v}), 1, 13))::UBIGINT::BIGINT"
    q = f"SELECT custom_id, n, a, b, x // b AS r, x % b AS c FROM {src}"
    for i in range(B.ROUNDS):
        q = (f"SELECT custom_id, n, a, b, (r + {hashed(i, 'c')}) % a AS r, c FROM ({q}) p{i}" if i % 2 == 0 else
             f"SELECT custom_id, n, a, b, r, (c + {hashed(i, 'r')}) % b AS c FROM ({q}) p{i}")
    return f"SELECT custom_id, r * b + c AS x, n, a, b FROM ({q}) p"


@register("shuffle_permuted", f"""
WITH RECURSIVE t AS (SELECT custom_id, row_number() OVER (ORDER BY custom_id) - 1 AS x, count(*) OVER () AS n FROM ({TRAIN}) t),
i AS (SELECT custom_id, x, n, (n + b - 1) // b AS a, b FROM (SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS b FROM t) s),
w AS ({_permute_sql('i')} UNION ALL {_permute_sql('(SELECT * FROM w WHERE x >= n) v')})
SELECT custom_id, x AS position FROM w WHERE x < n
""")
def q_shuffle_permuted(spark, sf):
    """A dense index, then the epoch's order as a map over it."""
    from tagwright.operators.prepare import assign_row_id
    d = assign_row_id(train_df(spark, sf).select("custom_id"), ["custom_id"], name="_i").checkpoint()
    return B.shuffle_permuted(d, "_i", d.count()).select("custom_id", "position")
