"""SQL counterparts of the registered queries, for DuckDB on the same parquet tables.

They say what each query must return in the plainest way (for instance history as
a join of every visit with every earlier one), not how it is computed at scale.
"""

from __future__ import annotations

VISITS = """visits AS (
  SELECT o_orderkey AS encounter_id, o_custkey AS patient_id, o_orderdate::TIMESTAMP AS admit_ts,
         o_orderdate::TIMESTAMP + to_days((o_orderkey % 14)::INTEGER) AS discharge_ts, (o_orderkey % 14)::INTEGER AS stay,
         (o_orderstatus = 'F')::INTEGER AS ed, (o_orderstatus = 'O')::INTEGER AS ip, (o_orderstatus = 'P')::INTEGER AS icu,
         o_orderpriority AS priority, o_totalprice AS amount
  FROM orders)"""

BORN = "(DATE '1930-01-01' + ({key} * 97 % 20000)::INTEGER)"


def months(at: str, born: str) -> str:
    return f"""round(((year({at}) - year({born})) * 12 + month({at}) - month({born}) + CASE
      WHEN day({at}) = day({born}) OR (last_day({at}) = {at}::DATE AND last_day({born}) = {born}::DATE) THEN 0::DOUBLE
      ELSE (day({at}) - day({born}))::DOUBLE / 31 END), 8)"""


def age(at: str, born: str) -> str:
    return f"round({months(at, born)} / 12, 1)"


PEOPLE = f"""people AS (
  SELECT c_custkey AS patient_id, c_mktsegment, {BORN.format(key="c_custkey")} AS born, n_name, r_name
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""

COHORT = f"""cohort AS (
  SELECT * FROM (SELECT v.*, n_name, r_name, c_mktsegment, {age("admit_ts", "born")} AS age
                 FROM visits v LEFT JOIN people p ON v.patient_id = p.patient_id)
  WHERE (ed = 1 OR ip = 1) AND age >= 18 AND discharge_ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31'
    AND c_mktsegment = 'BUILDING' AND r_name IS NOT NULL AND r_name NOT IN ('AFRICA') AND n_name NOT IN ('NATION_7', 'NATION_13'))"""

FIRST_LINES = """first_lines AS (
  SELECT l_orderkey AS encounter_id, l_shipdate::TIMESTAMP AS arrival_ts, l_returnflag AS arrival_method
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS rn
        FROM lineitem WHERE l_shipdate IS NOT NULL) WHERE rn = 1)"""

DIAGNOSES = """diagnoses AS (
  SELECT l_orderkey AS encounter_id, p_type AS code, CASE l_returnflag WHEN 'A' THEN 'Y' WHEN 'N' THEN 'N' ELSE 'U' END AS present
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def history(index: str) -> str:
    return f"""prior AS (
      SELECT v.*, coalesce((SELECT max(1) FROM diagnoses d WHERE d.encounter_id = v.encounter_id AND d.code = 'PROMO'), 0) AS promo FROM visits v),
    pairs AS (
      SELECT i.encounter_id, p.encounter_id AS prior_id, p.discharge_ts, p.ed, p.ip, p.icu, p.stay, p.promo,
             datesub('day', p.discharge_ts, i.admit_ts) AS days
      FROM {index} i JOIN prior p ON i.patient_id = p.patient_id AND p.discharge_ts < i.admit_ts),
    history AS (
      SELECT encounter_id, count(*) FILTER (days <= 365)::BIGINT AS n_past_year,
             min(days) FILTER (ed = 1)::BIGINT AS days_since_ed, min(days) FILTER (ip = 1)::BIGINT AS days_since_ip,
             min(days) FILTER (icu = 1)::BIGINT AS days_since_icu, max(promo)::INTEGER AS any_prev_promo,
             (first(stay ORDER BY discharge_ts DESC, prior_id DESC) FILTER (ip = 1))::INTEGER AS last_ip_stay
      FROM pairs GROUP BY encounter_id)"""


INTERVALS = """intervals AS (
  SELECT user_id, event_id, event_type AS ward, ts AS start_ts, ts + to_minutes(floor(value * 10)::BIGINT) AS end_ts FROM events),
first_seen AS (SELECT user_id, min(ts) AS first_ts FROM events GROUP BY user_id),
state_3h AS (
  SELECT * FROM (
    SELECT i.*, row_number() OVER (PARTITION BY i.user_id ORDER BY start_ts, event_id) AS rn
    FROM intervals i JOIN first_seen f USING (user_id)
    WHERE start_ts < first_ts + INTERVAL 3 HOURS AND end_ts > first_ts + INTERVAL 3 HOURS) WHERE rn = 1)"""


def _measure(name: str, when: str) -> str:
    f = f"FILTER (e.ts <= first_ts + to_hours(hour) {when})"
    o = "ORDER BY e.ts, e.event_id"
    return f"""first(e.value {o}) {f} AS {name}_first, last(e.value {o}) {f} AS {name}_last,
      min(e.value) {f} AS {name}_min, max(e.value) {f} AS {name}_max, round(avg(e.value) {f}, 6) AS {name}_mean,
      round(last(e.value {o}) {f} - first(e.value {o}) {f}, 6) AS {name}_change"""


PANEL = f"""first_seen AS (SELECT user_id, min(ts) AS first_ts FROM events GROUP BY user_id),
panel AS (
  SELECT f.user_id, hour::INTEGER AS hour, count(*) FILTER (e.ts <= first_ts + to_hours(hour))::BIGINT AS n_events,
      {_measure("reading", "")}, {_measure("click", "AND event_type = 'click'")}
  FROM first_seen f JOIN events e USING (user_id), (SELECT unnest([1, 3, 6, 12, 24]) AS hour)
  GROUP BY f.user_id, hour)"""

SCORED = """scored AS (
  SELECT o_orderkey AS encounter_id, ([1, 3, 6, 12, 24])[(o_orderkey % 5 + 1)::INTEGER]::INTEGER AS hour,
         (round(o_totalprice * 100)::BIGINT // 5000) / 10000::DOUBLE AS score,
         CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F') THEN 1 ELSE 0 END AS label
  FROM orders)"""


def curve(by: str = "") -> str:
    """Threshold table; `by` is empty or a column name."""
    g = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""points AS (
      SELECT {g}score AS cutoff, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM scored GROUP BY ALL),
    sums AS (
      SELECT *, (sum(pos) OVER ({part} ORDER BY cutoff DESC))::BIGINT AS tp, (sum(neg) OVER ({part} ORDER BY cutoff DESC))::BIGINT AS fp,
             lead(pos) OVER ({part} ORDER BY cutoff DESC) AS next_pos,
             (sum(pos) OVER ({part}))::BIGINT AS n_pos, (sum(neg) OVER ({part}))::BIGINT AS n_neg FROM points),
    curve AS (
      SELECT *, n_pos - tp AS fn, n_neg - fp AS tn, (tp + fp) / (n_pos + n_neg) AS rpp, tp / nullif(n_pos, 0) AS sens,
             (n_neg - fp) / nullif(n_neg, 0) AS spec, tp / nullif(tp + fp, 0) AS ppv, (n_neg - fp) / nullif(n_neg - fp + n_pos - tp, 0) AS npv
      FROM sums)"""


def confusion(source: str, by: str = "", cutoff: str = "0.5") -> str:
    g = f"{by}, " if by else ""
    return f"""c AS (
      SELECT {g}count(*) FILTER (score > {cutoff} AND label = 1) AS tp, count(*) FILTER (score > {cutoff} AND label <> 1) AS fp,
             count(*) FILTER (score <= {cutoff} AND label = 1) AS fn, count(*) FILTER (score <= {cutoff} AND label <> 1) AS tn
      FROM {source} GROUP BY ALL),
    d AS (SELECT *, (tp + fp + fn + tn)::DOUBLE AS n FROM c),
    e AS (SELECT *, (tp + tn) / n AS acc, ((tp + fp)::DOUBLE * (tp + fn) + (fn + tn)::DOUBLE * (fp + tn)) / (n * n) AS chance FROM d)
    SELECT {g}tp, fp, fn, tn, round(acc, 9) AS accuracy, round(greatest(tp + fn, fp + tn) / n, 9) AS no_information_rate,
           round((acc - chance) / nullif(1 - chance, 0), 9) AS kappa, round(pow(abs(fp - fn) - 1, 2) / nullif(fp + fn, 0), 9) AS mcnemar,
           round(tp / nullif(tp + fn, 0), 9) AS sens, round(tn / nullif(fp + tn, 0), 9) AS spec, round(tp / nullif(tp + fp, 0), 9) AS ppv,
           round(tn / nullif(tn + fn, 0), 9) AS npv, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1, round((tp + fn) / n, 9) AS prevalence,
           round(tp / n, 9) AS detection_rate, round((tp + fp) / n, 9) AS detection_prevalence,
           round((tp / nullif(tp + fn, 0) + tn / nullif(fp + tn, 0)) / 2, 9) AS balanced_accuracy
    FROM e"""


def at(thresholds: str, compare: str = ">=") -> str:
    return f"""t AS (SELECT unnest({thresholds}::DOUBLE[]) AS threshold),
    k AS (SELECT threshold, count(*) FILTER (score {compare} threshold AND label = 1) AS tp, count(*) FILTER (score {compare} threshold AND label <> 1) AS fp,
                 count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label <> 1) AS n_neg FROM scored, t GROUP BY threshold),
    r AS (SELECT *, n_pos - tp AS fn, n_neg - fp AS tn, (tp + fp) / (n_pos + n_neg) AS rpp, tp / n_pos AS sens, (n_neg - fp) / n_neg AS spec,
                 tp / nullif(tp + fp, 0) AS ppv, (n_neg - fp) / nullif(n_neg - fp + n_pos - tp, 0) AS npv FROM k)"""


def md5_of(seed: object, *keys: str) -> str:
    return f"md5(concat('{seed}', {', '.join(part for k in keys for part in (chr(39) + ':' + chr(39), k + '::VARCHAR'))}))"


def hash_number(seed: object, *keys: str) -> str:
    return f"('0x' || substr({md5_of(seed, *keys)}, 1, 8))::UBIGINT::BIGINT"


SPLIT = f"""split AS (
  SELECT encounter_id, label, row_number() OVER (PARTITION BY label ORDER BY {md5_of(124800, "encounter_id")}, encounter_id)
         <= ceil(round(0.7 * count(*) OVER (PARTITION BY label), 6)) AS is_train FROM scored)"""

CUSTOMERS = """customers AS (
  SELECT c_custkey, nullif(c_mktsegment, 'MACHINERY') AS c_mktsegment, 'n' || (c_nationkey % 7)::VARCHAR AS area FROM customer)"""

BRANDED = "branded AS (SELECT o_orderkey AS encounter_id, CASE WHEN o_custkey % 11 <> 0 THEN 'Brand#' || (o_custkey % 40)::VARCHAR END AS code FROM orders)"
FIRST_PART = """first_part AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1)"""

CLEAN_ORDERS = "clean AS (SELECT o_orderstatus, nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority, o_custkey FROM orders)"

CODE_FLAGS = """max(CASE WHEN code = 'PROMO' THEN 1 ELSE 0 END) AS dx_promo, max(CASE WHEN code = 'ECONOMY' THEN 1 ELSE 0 END) AS dx_economy,
         max(CASE WHEN code IN ('SMALL', 'LARGE') THEN 1 ELSE 0 END) AS dx_sized"""


def poa(codes: str, name: str) -> str:
    return f"max(CASE WHEN code IN ({codes}) THEN CASE present WHEN 'Y' THEN 1 WHEN 'E' THEN 1 WHEN 'N' THEN 0 END END) AS {name}_poa"


FLAGS = f"""{VISITS},
{SCORED},
{SPLIT},
flags AS (
  SELECT encounter_id, label, is_train, ed, ip, (stay >= 7)::INTEGER AS long_stay, CASE WHEN priority IN ('1-URGENT', '2-HIGH') THEN 'high' ELSE 'low' END AS urgency
  FROM split JOIN visits USING (encounter_id)),
folds AS (
  SELECT *, ((row_number() OVER (PARTITION BY label ORDER BY {md5_of(1234, "encounter_id")}, encounter_id) - 1) % 2)::INTEGER AS fold FROM flags WHERE is_train)"""
CELL = "ed, ip, long_stay, urgency"


def boosted(name: str, source: str, by: str, settings: str = "(SELECT 0.1::DOUBLE AS eta)", rounds: int = 3) -> str:
    """A boosted model of flags: per cell the margin after each round. The first tree is the mean of +1 and -1, each later one
    the mean of what the logistic loss leaves, times eta."""
    step = "f + eta * (p * 4 / (1 + exp(2 * f)) - (1 - p) * 4 / (1 + exp(-2 * f)))"
    return f"""{name} AS (
  WITH RECURSIVE grown AS (
    SELECT {by}{CELL}, eta, 1 AS round, p, 2 * p - 1 AS f FROM (SELECT {by}{CELL}, avg(label::DOUBLE) AS p FROM {source} GROUP BY ALL), {settings}
    UNION ALL
    SELECT {by}{CELL}, eta, round + 1, p, {step} FROM grown WHERE round < {rounds})
  SELECT *, 1 / (1 + exp(-2 * f)) AS score FROM grown)"""


def newton(name: str, source: str, by: str, settings: str = "(SELECT 0.5::DOUBLE AS eta)", rounds: int = 3) -> str:
    """A boosted model of flags by second-order steps without a penalty: per cell the margin after each round."""
    return f"""{name} AS (
  WITH RECURSIVE grown AS (
    SELECT {by}{CELL}, eta, 0 AS round, avg(label::DOUBLE) AS p, 0::DOUBLE AS f FROM {source}, {settings} GROUP BY ALL
    UNION ALL
    SELECT {by}{CELL}, eta, round + 1, p, f + eta * (p - 1 / (1 + exp(-f))) * (1 + exp(-f)) * (1 + exp(f)) FROM grown WHERE round < {rounds})
  SELECT *, 1 / (1 + exp(-f)) AS score FROM grown WHERE round > 0)"""


def stumps(rounds: int = 3, eta: float = 0.5, penalty: float = 2, least: float = 1) -> str:
    """Trees of one split over the cells of flags: per round the sums of each flag's sides, the best flag, and the cells' new margins."""
    flags = ["ed", "ip", "long_stay", "urgent"]
    parts = [f"""cells0 AS (SELECT ed, ip, long_stay, (urgency = 'high')::INTEGER AS urgent, count(*) AS n, sum(label) AS y, 0::DOUBLE AS f FROM flags WHERE is_train GROUP BY ALL)"""]
    for k in range(rounds):
        parts.append(f"""sides{k} AS (
  SELECT flag, any_value(place) AS place, sum(g) FILTER (x = 0) AS gl, sum(h) FILTER (x = 0) AS hl, sum(g) FILTER (x = 1) AS gr, sum(h) FILTER (x = 1) AS hr FROM (
    SELECT unnest({flags!r}) AS flag, unnest([0, 1, 2, 3]) AS place, unnest([{", ".join(flags)}]) AS x, n / (1 + exp(-f)) - y AS g, n / (1 + exp(-f)) / (1 + exp(f)) AS h FROM cells{k}) GROUP BY flag),
best{k} AS (
  SELECT *, gl * gl / (hl + {penalty}) + gr * gr / (hr + {penalty}) - (gl + gr) * (gl + gr) / (hl + hr + {penalty}) AS gain, -{eta} * gl / (hl + {penalty}) AS left_value, -{eta} * gr / (hr + {penalty}) AS right_value
  FROM sides{k} WHERE hl >= {least} AND hr >= {least} ORDER BY round(gain, 9) DESC, place LIMIT 1),
cells{k + 1} AS (SELECT c.* REPLACE (f + CASE WHEN [{", ".join(flags)}][place + 1] = 0 THEN left_value ELSE right_value END AS f) FROM cells{k} c, best{k})""")
    trees = "\n  UNION ALL ".join(f"SELECT {k} AS tree, flag, gain, hl, hr, left_value, right_value FROM best{k}" for k in range(rounds))
    return ",\n".join(parts) + f",\ntrees AS ({trees})"


def area(source: str, by: str) -> str:
    """Area under the ROC curve per group, ties counting half."""
    return f"""area AS (
  SELECT {by}, sum(pos * (below + 0.5::DOUBLE * neg)) / (sum(pos)::DOUBLE * sum(neg)) AS c FROM (
    SELECT *, coalesce(sum(neg) OVER (PARTITION BY {by} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
      SELECT {by}, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM {source} GROUP BY ALL))
  GROUP BY {by})"""


def two_sided(chi: str) -> str:
    """Chance of a chi-squared value (one degree of freedom) above this one: erfc of its half's root, by the series of erf."""
    z2 = f"({chi} / 2)"
    each = f"exp(-{z2} + 2 * i * ln(2) + (i + 0.5) * ln({z2}) - lgamma(2 * i + 2) + lgamma(i + 1))"
    return f"CASE WHEN {chi} > 72 THEN 0 WHEN {chi} = 0 THEN 1 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 400), lambda i: {each})) END"


def tail(first: str, last: str, n: str, p: str) -> str:
    """P(first <= X <= last) for X binomial(n, p)."""
    each = f"exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p}))"
    return f"list_sum(list_transform(range(({first})::BIGINT, ({last} + 1)::BIGINT), lambda i: {each}))"


GRID = f"""{boosted("model", "train", "k, ", "(SELECT unnest([0.1, 0.3]::DOUBLE[]) AS eta)")},
rated AS (SELECT f.label, m.k, m.eta, m.round, m.score FROM folds f JOIN model m USING ({CELL}) WHERE m.k = f.fold AND m.round IN (1, 3)),
{area("rated", "k, eta, round")},
hits AS (
  SELECT k, eta, round, count(*) FILTER (score > 0.5 AND label = 1) / count(*) FILTER (label = 1) AS sens,
         count(*) FILTER (score <= 0.5 AND label <> 1) / count(*) FILTER (label <> 1) AS spec FROM rated GROUP BY ALL),
settings AS (
  SELECT round AS rounds, eta, round(avg(c), 9) AS roc, round(avg(sens), 9) AS sens, round(avg(spec), 9) AS spec, round(stddev_samp(c), 9) AS roc_sd,
         round(stddev_samp(sens), 9) AS sens_sd, round(stddev_samp(spec), 9) AS spec_sd
  FROM area JOIN hits USING (k, eta, round) GROUP BY ALL)"""
NEWTON_GRID = GRID.replace(boosted("model", "train", "k, ", "(SELECT unnest([0.1, 0.3]::DOUBLE[]) AS eta)"), newton("model", "train", "k, ", "(SELECT unnest([0.1, 0.5]::DOUBLE[]) AS eta)"))
LEFT_OUT = "train AS (SELECT k, f.* FROM folds f, (SELECT unnest([0, 1]) AS k) WHERE f.fold <> k)"


def w(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


SCORES_COUNTED = "SELECT {by} score AS cutoff, count(*) AS n, count(*) FILTER (label = 1) AS pos FROM scored GROUP BY ALL"


def isotonic(counts: str) -> str:
    """Walks from corner to corner of the line over (rows, positives): the next corner is where the steepest line from this one ends."""
    return w(SCORED, f"""points AS MATERIALIZED (
      SELECT *, sum(n) OVER (PARTITION BY g ORDER BY cutoff DESC)::BIGINT AS x, sum(pos) OVER (PARTITION BY g ORDER BY cutoff DESC)::BIGINT AS y FROM {counts})""", """walk AS (
      WITH RECURSIVE corner AS (
        SELECT DISTINCT g, 0::BIGINT AS x, 0::BIGINT AS y, 0::BIGINT AS start, 0::DOUBLE AS rate FROM points
        UNION ALL
        SELECT g, x, y, start, slope FROM (
          SELECT p.g, p.x, p.y, c.x AS start, (p.y - c.y)::DOUBLE / (p.x - c.x) AS slope,
                 row_number() OVER (PARTITION BY p.g ORDER BY (p.y - c.y)::DOUBLE / (p.x - c.x) DESC, p.x DESC) AS rn
          FROM corner c JOIN points p ON p.g = c.g AND p.x > c.x) WHERE rn = 1)
      SELECT * FROM corner WHERE x > 0)""", """pooled AS (
      SELECT p.g, p.cutoff, p.n, p.pos, round(k.rate, 9) AS rate FROM points p JOIN walk k ON p.g = k.g AND p.x > k.start AND p.x <= k.x)""")


POINT_ROUNDED = "round(sens, 9) AS sens, round(spec, 9) AS spec, round(ppv, 9) AS ppv"
RATES = ", ".join(f"round({c}, 9) AS {c}" for c in ("rpp", "sens", "spec", "ppv", "npv"))
CURVE_ROWS = f"SELECT cutoff, pos, neg, next_pos, tp, fp, fn, tn, {RATES} FROM curve"
HISTORY_COLUMNS = "encounter_id, n_past_year, days_since_ed, days_since_ip, days_since_icu, any_prev_promo, last_ip_stay"

HOURLY = """hourly AS (
  SELECT p.patient_id, p.asked_id, p.hour, any_value(s.admit_ts) AS admit_ts, any_value(s.discharge_ts) AS discharge_ts, any_value(s.encounter_id) AS encounter_id
  FROM (SELECT patient_id, encounter_id AS asked_id, h::INTEGER AS hour, admit_ts + to_hours(h::INTEGER) AS t FROM (SELECT *, unnest(range(24)) AS h FROM visits)) p
  LEFT JOIN (SELECT v.*, x.asked_id, x.hour FROM (SELECT patient_id, encounter_id AS asked_id, h::INTEGER AS hour, admit_ts + to_hours(h::INTEGER) AS t FROM (SELECT *, unnest(range(24)) AS h FROM visits)) x
             JOIN visits v ON v.patient_id = x.patient_id AND v.admit_ts < x.t AND v.discharge_ts > x.t
             QUALIFY row_number() OVER (PARTITION BY x.asked_id, x.hour ORDER BY v.admit_ts, v.discharge_ts DESC, v.encounter_id) = 1) s
  ON s.asked_id = p.asked_id AND s.hour = p.hour GROUP BY ALL)"""
_POINTS = ", ".join(f"round(quantile_cont(value, {q}), 6) AS q{round(100 * q):02d}" for q in (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95))
_ENDS = ", ".join(f"(list_sort(list_distinct(list(value))))[{k + 1}] AS lowest{k + 1}, (list_sort(list_distinct(list(value))))[-{5 - k}] AS highest{k + 1}" for k in range(5))
PROFILE = f"""
  WITH long AS (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_tax']) AS "column", unnest([l_quantity, l_extendedprice, nullif(l_tax, 0)]) AS value FROM lineitem),
  placed AS (SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY value) AS i, count(*) OVER (PARTITION BY "column") AS n FROM long WHERE value IS NOT NULL),
  ties AS (SELECT "column", sum(power(c, 3)) AS cubes FROM (SELECT "column", value, count(*)::DOUBLE AS c FROM placed GROUP BY ALL) GROUP BY "column"),
  gaps AS (SELECT "column", (SELECT count(*) FROM long l WHERE l."column" = p."column" AND l.value IS NULL) AS missing FROM (SELECT DISTINCT "column" FROM long) p)
  SELECT "column", any_value(n) AS n, any_value(missing) AS missing, count(DISTINCT value) AS "distinct", round((1 - any_value(cubes) / power(any_value(n), 3)) / (1 - 1 / power(any_value(n), 2)), 6) AS info,
         round(avg(value), 6) AS mean, round(2 * sum(value * (2 * i - n - 1)) / (any_value(n)::DOUBLE * (any_value(n) - 1)), 6) AS gmd, {_POINTS}, {_ENDS}
  FROM placed JOIN ties USING ("column") JOIN gaps USING ("column") GROUP BY "column" """

SQL = {
    # sources
    "delimited_scan": "SELECT o_totalprice AS amount, o_orderkey AS encounterid, nullif(o_orderstatus, 'P') AS status FROM orders",
    "text_scan": "SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_size::VARCHAR AS p_size FROM part",
    "panel_hours_scan": w(PANEL) + "SELECT user_id, n_events, reading_max, hour FROM panel WHERE hour IN (1, 6)",
    "extract_reload": w(VISITS) + "SELECT encounter_id, admit_ts FROM visits WHERE admit_ts BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'",
    # cohort, cleaning, recodes, lookups, codes
    "cohort_filter": w(VISITS, PEOPLE, COHORT) + "SELECT encounter_id, patient_id, age, n_name, r_name FROM cohort",
    "star_lookup": w(PEOPLE) + "SELECT patient_id, lower(n_name) AS nation, lower(r_name) AS region FROM people",
    "null_token_cleaning": """
        SELECT o_orderkey AS encounter_id, nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority, nullif(o_orderstatus, 'P') AS status,
               coalesce(nullif(o_orderpriority, '4-NOT SPECIFIED'), '0') AS priority_filled, (o_orderpriority <> '4-NOT SPECIFIED')::INTEGER AS has_priority
        FROM orders""",
    "recode_ladder": w(VISITS) + """
        SELECT encounter_id,
               CASE WHEN lower(priority) IN ('1-urgent', '2-high') THEN 'high' WHEN lower(priority) = '3-medium' THEN 'normal'
                    WHEN lower(priority) LIKE '%low%' THEN 'low' END AS priority_group,
               CASE WHEN icu = 1 THEN 'ed_admitted' WHEN ip = 1 THEN 'ip_not_through_ed' WHEN ed = 1 THEN 'ed_not_admitted' END AS route,
               (ed = 1 OR icu = 1)::INTEGER AS any_acute, CASE WHEN ed = 1 OR icu = 1 THEN 'yes' ELSE 'no' END AS any_acute_yn,
               CASE stay WHEN 1 THEN 'Yes' WHEN 2 THEN 'No' END AS answer, rtrim(lower(priority)) AS priority_text
        FROM visits""",
    "race_merge": """
        WITH t AS (
          SELECT c_custkey AS patient_id,
                 CASE c_mktsegment WHEN 'BUILDING' THEN 'other' WHEN 'MACHINERY' THEN 'white' WHEN 'FURNITURE' THEN 'black' WHEN 'HOUSEHOLD' THEN 'unknown' END AS race,
                 (['hispanic', 'asian/oriental', 'african american/black', 'white/caucasian', NULL])[(c_custkey % 5 + 1)::INTEGER] AS eth
          FROM customer),
        m AS (
          SELECT patient_id,
                 CASE WHEN eth = 'hispanic' AND (race IS NULL OR race IN ('other', 'unknown', 'white')) THEN 'hispanic'
                      WHEN race IS NOT NULL THEN race WHEN eth = 'asian/oriental' THEN 'asian' WHEN eth = 'african american/black' THEN 'black'
                      WHEN eth = 'white/caucasian' THEN 'white' END AS race FROM t)
        SELECT patient_id, race, CASE WHEN race = 'white' THEN 'White' WHEN race <> 'white' THEN 'Non-white' END AS nonwhite FROM m""",
    "arrival_mode": """
        WITH t AS (SELECT o_orderkey AS encounter_id, CASE WHEN o_orderkey % 7 <> 1 THEN o_orderkey % 3 = 0 END AS stretcher,
                          CASE WHEN o_orderkey % 7 <> 2 THEN o_orderkey % 4 = 0 END AS ambulatory,
                          CASE WHEN o_orderkey % 7 <> 3 THEN o_orderkey % 5 = 0 END AS fire,
                          CASE WHEN o_orderkey % 7 <> 4 THEN o_orderkey % 6 = 0 END AS ambulance FROM orders)
        SELECT encounter_id, coalesce((stretcher OR (NOT ambulatory AND (fire OR ambulance)))::INTEGER, -9999) AS carried_in FROM t""",
    "lookup_first_match": w(BRANDED, FIRST_PART) + "SELECT encounter_id, code, p_type AS first_type, p_size AS first_size FROM branded LEFT JOIN first_part ON code = p_brand",
    "grouped_lookup": w(BRANDED, FIRST_PART) + """
        SELECT encounter_id, code, CASE WHEN code IS NOT NULL THEN coalesce(CASE WHEN p_size > 25 THEN p_name END, lower(p_type), 'other') END AS category
        FROM branded LEFT JOIN first_part ON code = p_brand""",
    "dedupe_first": w(VISITS) + """
        SELECT patient_id, encounter_id, admit_ts, priority FROM (
          SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY admit_ts, encounter_id DESC) AS rn FROM visits) WHERE rn = 1""",
    "first_event_per_entity": w(VISITS, FIRST_LINES) + "SELECT v.encounter_id, arrival_ts, arrival_method FROM visits v LEFT JOIN first_lines f ON v.encounter_id = f.encounter_id",
    "presentation": w(VISITS, FIRST_LINES) + """
        SELECT v.encounter_id, CASE WHEN arrival_ts < admit_ts THEN arrival_ts ELSE admit_ts END AS presentation_ts
        FROM visits v LEFT JOIN first_lines f ON v.encounter_id = f.encounter_id""",
    "age_in_years": w(VISITS) + f"SELECT encounter_id, {age('admit_ts', 'born')} AS age FROM (SELECT *, {BORN.format(key='patient_id')} AS born FROM visits)",
    "discharge_cleaning": """
        WITH t AS (SELECT o_orderkey AS encounter_id, o_orderstatus, o_orderdate::DATE AS d,
                          date_trunc('day', o_orderdate) + to_seconds(o_orderkey % 24 * 3600 + o_orderkey % 60 * 60 + o_orderkey * 7 % 60) AS admit_ts FROM orders),
        u AS (SELECT *, CASE WHEN o_orderstatus <> 'O' THEN admit_ts + to_days((encounter_id % 14)::INTEGER) END AS discharge_ts FROM t)
        SELECT encounter_id, admit_ts, discharge_ts, datediff('day', d, coalesce(discharge_ts::DATE, DATE '2001-12-31'))::INTEGER AS stay_days FROM u""",
    "keyword_flag_text": """
        SELECT doc_id, coalesce(lower(text) LIKE '%license%', false)::INTEGER AS has_license, coalesce(lower(text) LIKE '%the%', false)::INTEGER AS has_the,
               coalesce(lower(text) LIKE '%avec%', false)::INTEGER AS has_avec FROM documents""",
    "shock_index_ratio": """
        SELECT p_partkey, round(p_retailprice / nullif(p_size % 5, 0), 6) AS si, round(p_retailprice / nullif(p_size % 5, 0) * p_size, 6) AS sia FROM part""",
    "code_flags_pivot": w(VISITS, DIAGNOSES, f"""f AS (
          SELECT encounter_id, {CODE_FLAGS}, {poa("'PROMO'", "dx_promo")}, {poa("'ECONOMY'", "dx_economy")}, {poa("'SMALL', 'LARGE'", "dx_sized")}
          FROM diagnoses GROUP BY encounter_id)""") + """
        SELECT v.encounter_id, coalesce(dx_promo, 0) AS dx_promo, dx_promo_poa, coalesce(dx_economy, 0) AS dx_economy, dx_economy_poa,
               coalesce(dx_sized, 0) AS dx_sized, dx_sized_poa, greatest(coalesce(dx_promo, 0), coalesce(dx_economy, 0)) AS any_dx
        FROM visits v LEFT JOIN f ON v.encounter_id = f.encounter_id""",
    "code_flags_regex": w(DIAGNOSES) + """
        SELECT encounter_id, max((code LIKE 'S%')::INTEGER) AS starts_s, max((code LIKE '%O')::INTEGER) AS ends_o FROM diagnoses
        GROUP BY encounter_id HAVING max((code LIKE 'S%' OR code LIKE '%O')::INTEGER) = 1""",
    "present_percent": w(DIAGNOSES) + """
        SELECT code, count(*) AS n, round(100.0 * count(*) FILTER (present = 'Y') / count(*) FILTER (present IN ('Y', 'N')), 0)::DOUBLE AS pct_present
        FROM diagnoses GROUP BY code""",
    "text_order_first": """
        SELECT l_orderkey AS encounter_id,
               max((p_name LIKE '%ring%' AND (p_name LIKE '%cold%' OR p_name LIKE '%hot%') OR p_name LIKE '%gi%' AND p_name LIKE '%old%' OR p_name = 'new plate')::INTEGER) AS ring,
               max((p_name LIKE '%rod%')::INTEGER) AS rod,
               min(l_shipdate) FILTER (p_name LIKE '%ring%' AND (p_name LIKE '%cold%' OR p_name LIKE '%hot%') OR p_name LIKE '%gi%' AND p_name LIKE '%old%' OR p_name = 'new plate') AS ring_ts,
               min(l_shipdate) FILTER (p_name LIKE '%rod%') AS rod_ts
        FROM lineitem JOIN part ON l_partkey = p_partkey
        WHERE l_linestatus = 'F' AND l_linenumber % 3 <> 2
          AND (p_name LIKE '%ring%' AND (p_name LIKE '%cold%' OR p_name LIKE '%hot%') OR p_name LIKE '%gi%' AND p_name LIKE '%old%' OR p_name = 'new plate' OR p_name LIKE '%rod%')
        GROUP BY l_orderkey""",
    "exposure_chain": """
        SELECT o_orderkey AS order_id, 'STAR~' || c_custkey::VARCHAR AS medication_cd, c_name AS medication_name, l_linenumber, l_partkey, l_suppkey,
               l_shipdate::TIMESTAMP AS discharge_dt
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        WHERE c_mktsegment = 'BUILDING' AND l_linestatus = 'F' AND l_shipdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-12-31'""",
    "fan_out_check": """
        SELECT n AS rows_per_key, count(*) AS n_keys FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) GROUP BY n""",
    "never_happened_fill": w(VISITS) + f"""
        SELECT encounter_id, coalesce(CASE WHEN ed = 1 THEN stay::BIGINT END, 2000 + {hash_number(124800, "encounter_id")} % 2000) AS days_since_ed FROM visits""",
    # history, point in time, panels
    "history_features": w(VISITS, DIAGNOSES, history("visits")) + f"SELECT {HISTORY_COLUMNS} FROM history",
    "history_features_segmented": w(VISITS, DIAGNOSES, history("visits")) + f"SELECT {HISTORY_COLUMNS} FROM history",
    "cohort_history": w(VISITS, PEOPLE, COHORT, DIAGNOSES, history("cohort")) + """
        SELECT c.encounter_id, patient_id, age, coalesce(n_past_year, 0) AS n_past_year, days_since_ed, days_since_ip, days_since_icu,
               coalesce(any_prev_promo, 0) AS any_prev_promo, coalesce(last_ip_stay, 0) AS last_ip_stay
        FROM cohort c LEFT JOIN history h ON c.encounter_id = h.encounter_id""",
    "year_count_expiry": w(VISITS, DIAGNOSES, history("visits")) + "SELECT encounter_id, n_past_year FROM history WHERE n_past_year > 0",
    "state_at_offset": w(INTERVALS) + "SELECT user_id, ward, start_ts, end_ts FROM state_3h",
    "location_flags": w(INTERVALS, """first_ward AS (SELECT user_id, first(ward ORDER BY start_ts, event_id) AS first_ward FROM intervals GROUP BY user_id)""") + """
        SELECT f.user_id, first_ward, s.ward AS ward_3h, (first_ward = 'purchase' OR coalesce(s.ward = 'purchase', false))::INTEGER AS bought,
               (first_ward IN ('error', 'signup') OR coalesce(s.ward IN ('error', 'signup'), false))::INTEGER AS trouble,
               (first_ward IN ('view', 'click') OR coalesce(s.ward IN ('view', 'click'), false))::INTEGER AS looked
        FROM first_ward f LEFT JOIN state_3h s ON f.user_id = s.user_id""",
    "band_join_24h": """
        SELECT e.user_id, e.event_id, anchor_id FROM events e JOIN (
          SELECT user_id, min(ts) AS anchor_ts, first(event_id ORDER BY ts, event_id) AS anchor_id FROM events WHERE value > 200 GROUP BY user_id) a
        ON e.user_id = a.user_id AND e.ts < anchor_ts + INTERVAL 24 HOURS AND e.ts > anchor_ts - INTERVAL 24 HOURS""",
    "state_at_every_hour": w(VISITS, HOURLY) + "SELECT * FROM hourly",
    "state_at_every_hour_segmented": w(VISITS, HOURLY) + "SELECT * FROM hourly",
    "band_pairs": """
        SELECT e.user_id, e.event_id, a.event_id AS anchor_id FROM events e JOIN events a ON e.user_id = a.user_id
        WHERE a.value > 200 AND e.ts < a.ts + INTERVAL 24 HOURS AND e.ts > a.ts - INTERVAL 24 HOURS""",
    "sparse_matrix": """
        WITH rows AS (SELECT l_orderkey * 8 + l_linenumber AS row_id, l_quantity, l_orderkey::VARCHAR AS a, l_returnflag AS b, l_linenumber FROM lineitem),
        train AS (SELECT * FROM rows WHERE l_linenumber <= 3 AND b <> 'A'),
        of_a AS (SELECT a, row_number() OVER (ORDER BY a) AS slot FROM (SELECT DISTINCT a FROM train)),
        of_b AS (SELECT b, (SELECT count(*) FROM of_a) + 1 + row_number() OVER (ORDER BY b) AS slot FROM (SELECT DISTINCT b FROM train)),
        wide AS (SELECT (SELECT count(*) FROM of_a) + 1 AS new_a, (SELECT count(*) FROM of_a) + 1 + (SELECT count(*) FROM of_b) + 1 AS new_b)
        SELECT row_id, new_b + 1 AS size, e.slot, e.value FROM (
          SELECT row_id, new_b, unnest([{slot: 0::BIGINT, value: l_quantity::DOUBLE}, {slot: coalesce(of_a.slot, new_a), value: 1::DOUBLE}, {slot: coalesce(of_b.slot, new_b), value: 1::DOUBLE}]) AS e
          FROM rows CROSS JOIN wide LEFT JOIN of_a USING (a) LEFT JOIN of_b USING (b)) WHERE e.value <> 0""",
    "observed_load": """
        WITH joined AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 > 0) ON o_custkey = c_custkey),
        one AS (SELECT count(*) AS n, count(*) FILTER (c_mktsegment IS NULL) AS no_segment, count(*) FILTER (status IS NULL) AS no_status, min(o_orderkey) AS low, max(o_orderkey) AS high,
                       count(*) FILTER (NOT o_orderkey >= 0) AS bad, (SELECT count(*) FROM orders) AS before FROM joined)
        SELECT unnest(['rows', 'missing c_mktsegment', 'missing status', 'least o_orderkey', 'greatest o_orderkey', 'broken key', 'rows_before_join', 'fan_out']) AS figure,
               unnest([n, no_segment, no_status, low, high, bad, before, n - before])::VARCHAR AS value FROM one""",
    "numeric_profile": PROFILE,
    "numeric_profile_segmented": PROFILE,
    "near_any_anchor_24h": """
        SELECT DISTINCT e.user_id, e.event_id FROM events e JOIN events a ON e.user_id = a.user_id
        WHERE a.value > 200 AND e.ts < a.ts + INTERVAL 24 HOURS AND e.ts > a.ts - INTERVAL 24 HOURS""",
    "state_at_hot": w(INTERVALS) + "SELECT user_id, ward, start_ts, end_ts FROM state_3h",
    "near_any_hot": """
        SELECT DISTINCT e.user_id, e.event_id FROM events e JOIN events a ON e.user_id = a.user_id
        WHERE a.value > 200 AND e.ts < a.ts + INTERVAL 24 HOURS AND e.ts > a.ts - INTERVAL 24 HOURS""",
    "snapshot_panel": w(PANEL) + "SELECT * FROM panel",
    "snapshot_panel_hot": w(PANEL) + "SELECT * FROM panel",
    "stream_snapshot_panel": w(PANEL) + "SELECT * FROM panel",
    "panel_merge": w(PANEL) + """
        SELECT c_custkey AS encounter_id, c_custkey % 3 AS outcome, c_mktsegment, hour, n_events FROM customer JOIN panel ON user_id = c_custkey
        WHERE c_custkey % 3 < 2 AND hour IN (1, 6)""",
    "panel_union": w(PANEL) + "SELECT user_id, hour, n_events, reading_last FROM panel WHERE hour IN (1, 6)",
    "panel_column_drop": w(PANEL) + "SELECT user_id, hour, reading_first, reading_last, reading_min, reading_max, reading_mean FROM panel",
    "random_hour_row": w(PANEL) + f"""
        SELECT user_id, hour, n_events FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {md5_of(124800, "user_id", "hour")}, hour) AS rn FROM panel) WHERE rn = 1""",
    "match_audit": w(VISITS) + """
        SELECT count(*) AS n_rows, count(*) FILTER (other_ts IS NULL) AS n_unmatched, count(*) FILTER (discharge_ts = other_ts) AS n_same,
               count(*) FILTER (discharge_ts < other_ts) AS n_left_earlier, count(*) FILTER (discharge_ts > other_ts) AS n_left_later
        FROM visits LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS other_ts FROM lineitem WHERE l_quantity > 25 GROUP BY l_orderkey) ON encounter_id = l_orderkey""",
    "date_window_slop": w(VISITS) + """
        SELECT encounter_id, discharge_ts FROM visits WHERE discharge_ts BETWEEN TIMESTAMP '1995-12-30' AND TIMESTAMP '1997-11-03'""",
    "stream_hourly_panel": """
        SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n_events, first(value ORDER BY ts, event_id) AS value_first,
               last(value ORDER BY ts, event_id) AS value_last, min(value) AS value_min, max(value) AS value_max, round(avg(value), 6) AS value_mean
        FROM events GROUP BY 1, 2""",
    # summaries
    "rate_by_age_band": w(VISITS, SCORED, f"""a AS (
          SELECT label, {age("admit_ts", "born")} AS age FROM (SELECT *, {BORN.format(key="patient_id")} AS born FROM visits) v JOIN scored s ON v.encounter_id = s.encounter_id),
        b AS (SELECT CASE WHEN age >= 0 AND age < 110 THEN '[' || (floor(age / 10) * 10)::BIGINT::VARCHAR || ',' || (floor(age / 10) * 10 + 10)::BIGINT::VARCHAR || ')' END AS age_band,
                     count(*) AS n, avg(label) AS rate FROM a GROUP BY 1)""") + """
        SELECT age_band, n, round(rate, 9) AS rate, round(rate - 1.959963984540054 * sqrt(rate * (1 - rate) / n), 9) AS lower,
               round(rate + 1.959963984540054 * sqrt(rate * (1 - rate) / n), 9) AS upper FROM b""",
    "rate_by_weight_band": w(VISITS, SCORED) + """
        SELECT CASE WHEN x >= 0 AND x < 1200 THEN '[' || (floor(x / 100) * 100)::BIGINT::VARCHAR || ',' || (floor(x / 100) * 100 + 100)::BIGINT::VARCHAR || ')' END AS band,
               count(*) AS n, round(avg(label), 9) AS rate
        FROM (SELECT amount / 1000 * 2.2046::DOUBLE AS x, label FROM visits v JOIN scored s ON v.encounter_id = s.encounter_id WHERE stay <> 0) GROUP BY 1""",
    "column_profile": w(CLEAN_ORDERS) + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS \"distinct\" FROM clean"
        for c in ("o_orderstatus", "o_orderpriority", "o_custkey")),
    "value_frequencies": w(CLEAN_ORDERS) + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n, round(count(*) / (SELECT count({c}) FROM clean), 9) AS proportion FROM clean WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in ("o_orderstatus", "o_orderpriority")),
    "missing_by_column": w(CLEAN_ORDERS) + """
        SELECT bool_or(o_orderstatus IS NULL) AS o_orderstatus, bool_or(o_orderpriority IS NULL) AS o_orderpriority, bool_or(o_custkey IS NULL) AS o_custkey FROM clean""",
    "indicator_row_sum": w(DIAGNOSES, f"f AS (SELECT encounter_id, {CODE_FLAGS} FROM diagnoses GROUP BY encounter_id)") + """
        SELECT o_orderkey AS encounter_id, coalesce(dx_promo + dx_economy + dx_sized, 0)::INTEGER AS n_codes FROM orders LEFT JOIN f ON o_orderkey = encounter_id""",
    "group_having_topk": """
        SELECT lower(p_name) AS name, lower(p_type) AS kind, count(*) AS n FROM part GROUP BY 1, 2 HAVING lower(p_name) LIKE '%ring%' ORDER BY 1, 2 LIMIT 20""",
    "group_sum_desc": "SELECT o_orderpriority AS category, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders GROUP BY 1 ORDER BY 2 DESC",
    "distinct_visits": "SELECT DISTINCT o_custkey AS patient_id, o_orderpriority AS priority FROM orders",
    "distinct_counts": "SELECT count(DISTINCT o_custkey) AS n_patients, count(DISTINCT o_orderdate) AS n_times FROM orders",
    "load_report": " UNION ALL ".join(
        f"SELECT '{t}' AS name, (SELECT count(*) FROM {t}) AS n_rows, (SELECT count(*) FROM (DESCRIBE SELECT * FROM {t}))::INTEGER AS n_columns" for t in ("orders", "lineitem", "customer", "events")),
    # splits and preparation
    "stratified_split": w(SCORED, SPLIT) + "SELECT encounter_id, label, is_train FROM split",
    "stratified_kfold": w(SCORED) + f"""
        SELECT encounter_id, label, ((row_number() OVER (PARTITION BY label ORDER BY {md5_of(1234, "encounter_id")}, encounter_id) - 1) % 5)::INTEGER AS fold FROM scored""",
    "half_split": f"SELECT o_orderkey AS encounter_id FROM orders WHERE {hash_number(7, 'o_orderkey')} < 2147483648",
    "train_rows": w(SCORED, SPLIT) + "SELECT l_orderkey AS encounter_id, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT encounter_id FROM split WHERE is_train)",
    "test_rows": w(SCORED, SPLIT) + "SELECT l_orderkey AS encounter_id, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT encounter_id FROM split WHERE NOT is_train)",
    "rest_rows": f"SELECT l_orderkey AS encounter_id, l_linenumber, l_quantity FROM lineitem WHERE {hash_number(7, 'l_orderkey')} >= 2147483648",
    "column_modes": w(CUSTOMERS) + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", (SELECT {c} FROM customers WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode" for c in ("c_mktsegment", "area")),
    "mode_impute": w(CUSTOMERS, "train AS (SELECT * FROM customers WHERE c_custkey % 10 < 7)") + """
        SELECT c_custkey, coalesce(c_mktsegment, (SELECT c_mktsegment FROM train WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS c_mktsegment,
               coalesce(area, (SELECT area FROM train WHERE area IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS area FROM customers""",
    "rare_pool": """
        SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) >= 0.04 * (SELECT count(p_brand) FROM part)) THEN p_brand ELSE 'other' END AS p_brand
        FROM part""",
    "one_hot": w(CUSTOMERS, "filled AS (SELECT c_custkey, coalesce(c_mktsegment, 'BUILDING') AS s, area FROM customers)") + "SELECT c_custkey, " + ", ".join(
        f"(s = '{v}')::INTEGER AS \"c_mktsegment_{v}\"" for v in ("BUILDING", "FURNITURE", "HOUSEHOLD")) + ", 0 AS c_mktsegment_new, " + ", ".join(
        f"(area = 'n{i}')::INTEGER AS area_n{i}" for i in range(1, 6)) + ", (area = 'n6')::INTEGER AS area_new FROM filled",
    "schema_guard": "SELECT o_orderstatus, count(*) AS n, max(o_orderkey) AS last_key, round(max(o_totalprice), 2) AS top_price FROM orders GROUP BY 1",
    "schema_compare": """
        WITH a AS (SELECT row_number() OVER () AS at, replace(replace(replace(replace(column_name, 'c_custkey', 'key'), 'c_name', 'name'), 'c_nationkey', 'nation'), 'c_acctbal', 'balance') AS name,
                          column_type FROM (DESCRIBE SELECT * FROM customer)),
             b AS (SELECT row_number() OVER () AS at, replace(replace(replace(replace(column_name, 's_suppkey', 'key'), 's_name', 'name'), 's_nationkey', 'nation'), 's_acctbal', 'balance') AS name,
                          column_type FROM (DESCRIBE SELECT * FROM supplier))
        SELECT coalesce(a.name, b.name) AS "column", a.name IS NOT NULL AS in_train, b.name IS NOT NULL AS in_new,
               coalesce(a.column_type = b.column_type, false) AS same_type, coalesce(a.at = b.at, false) AS same_place FROM a FULL JOIN b ON a.name = b.name""",
    "renamed_columns": "SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey FROM supplier",
    "label_words": w(SCORED) + "SELECT encounter_id, CASE WHEN label = 1 THEN 'yes' ELSE 'no' END AS outcome_yn FROM scored",
    "not_measured_fill": """
        SELECT event_id, nullif(event_type, 'view') AS event_type, CASE WHEN event_type = 'click' THEN value ELSE -9999 END AS click_value FROM events""",
    # thresholds and evaluation
    "score_curve": w(SCORED, curve()) + CURVE_ROWS,
    "score_curve_segmented": w(SCORED, curve()) + CURVE_ROWS,
    "auc_by_hour": w(SCORED, curve("hour")) + """
        SELECT hour, round(c, 9) AS c, round(2 * (c - 0.5::DOUBLE), 9) AS dxy, n, missing FROM (
          SELECT hour, sum(pos * (n_neg - fp + 0.5::DOUBLE * neg)) / (max(n_pos)::DOUBLE * max(n_neg)) AS c, max(n_pos + n_neg) AS n, 0::BIGINT AS missing FROM curve GROUP BY hour)""",
    "two_class_by_hour": w(SCORED, curve("hour")) + """
        SELECT a.hour, round(roc, 9) AS roc, round(sens, 9) AS sens, round(spec, 9) AS spec FROM
          (SELECT hour, sum(pos * (n_neg - fp + 0.5::DOUBLE * neg)) / (max(n_pos)::DOUBLE * max(n_neg)) AS roc FROM curve GROUP BY hour) a JOIN
          (SELECT hour, count(*) FILTER (score > 0.5 AND label = 1) / count(*) FILTER (label = 1) AS sens,
                  count(*) FILTER (score <= 0.5 AND label <> 1) / count(*) FILTER (label <> 1) AS spec FROM scored GROUP BY hour) b ON a.hour = b.hour""",
    "confusion": "WITH " + SCORED + ",\n" + confusion("scored", "hour"),
    "confusion_document_labels": "WITH scored AS (SELECT quality::DOUBLE AS score, toxic AS label FROM labels),\n" + confusion("scored"),
    "at_thresholds": w(SCORED, at("[0.1, 0.25, 0.5, 0.9]")) + f"SELECT threshold, tp, fp, {RATES} FROM r",
    "best_threshold": w(SCORED, curve("hour")) + f"""
        SELECT hour, cutoff, {POINT_ROUNDED}, round(sens + spec, 9) AS objective FROM (
          SELECT *, row_number() OVER (PARTITION BY hour ORDER BY round(sens + spec, 12) DESC, cutoff) AS rn FROM curve) WHERE rn = 1""",
    "best_threshold_weighted": w(SCORED, curve()) + f"""
        SELECT cutoff, {POINT_ROUNDED}, round(sens + 0.8::DOUBLE / 0.6000000000000001::DOUBLE * spec, 9) AS objective FROM curve
        ORDER BY round(sens + 0.8::DOUBLE / 0.6000000000000001::DOUBLE * spec, 12) DESC, cutoff LIMIT 1""",
    "curve_local_maxima": w(SCORED, curve()) + "SELECT cutoff, tp, fp, round(sens, 9) AS sens, round(spec, 9) AS spec FROM curve WHERE pos > 0 AND coalesce(next_pos, 0) = 0",
    "alert_cutoffs": w(SCORED, curve("hour"), "rates AS (SELECT unnest([0.01, 0.02, 0.03]::DOUBLE[]) AS alert_rate)") + f"""
        SELECT hour, alert_rate, cutoff, {POINT_ROUNDED} FROM (
          SELECT *, row_number() OVER (PARTITION BY hour, alert_rate ORDER BY cutoff) AS rn FROM curve, rates WHERE rpp < alert_rate) WHERE rn = 1""",
    "first_cutoff_above": w(SCORED, curve("hour")) + "SELECT hour, max(cutoff) AS cutoff FROM curve WHERE rpp > 0.01 GROUP BY hour",
    "break_even": w(SCORED, curve()) + f"""
        SELECT cutoff, {POINT_ROUNDED}, round(abs(ppv - sens), 9) AS gap FROM curve ORDER BY round(abs(ppv - sens), 12), cutoff DESC LIMIT 1""",
    "calibration": w(SCORED, curve()) + """
        SELECT part, n, round(s / n, 9) AS mean_score, round(y / n, 9) AS observed, round(abs(s / n - y / n), 9) AS error FROM (
          SELECT (floor((tp + fp - pos - neg) * 10 / (n_pos + n_neg)) + 1)::INTEGER AS part, sum(pos + neg)::BIGINT AS n, sum(cutoff * (pos + neg)) AS s, sum(pos)::DOUBLE AS y
          FROM curve GROUP BY 1)""",
    "isotonic_score": isotonic(f"(SELECT 0 AS g, * FROM ({SCORES_COUNTED.format(by='')}))") + "SELECT cutoff, n, pos, rate FROM pooled",
    "isotonic_score_by_hour": isotonic(f"({SCORES_COUNTED.format(by='hour AS g,')})") + "SELECT g AS hour, cutoff, n, pos, rate FROM pooled",
    "smoothed_rate": w(SCORED, """near AS (
        SELECT hour, k * 0.125::DOUBLE AS point, score - k * 0.125::DOUBLE AS d, label FROM scored, range(-3, 12) r(k)), weights AS (
        SELECT *, pow(1 - pow(abs(d) / 0.3125::DOUBLE, 3), 3) AS wt FROM near WHERE abs(d) < 0.3125), sums AS (
        SELECT hour, point, count(*) AS n, sum(wt) AS s0, sum(wt * d) AS s1, sum(wt * d * d) AS s2, sum(wt * label) AS t0, sum(wt * label * d) AS t1
        FROM weights GROUP BY hour, point HAVING min(d) <= 0 AND max(d) >= 0)""") + """
        SELECT hour, point AS "at", n, round(least(greatest(CASE WHEN s0 * s2 - s1 * s1 > 1e-9 * s0 * s2 THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END, 0), 1), 9) AS rate FROM sums""",
    "area_under_pr": w(SCORED, curve("hour")) + """
        SELECT hour, round(sum(pos / n_pos * (ppv + before) / 2), 9) AS aucpr FROM (
          SELECT *, coalesce(lag(ppv) OVER (PARTITION BY hour ORDER BY cutoff DESC), ppv) AS before FROM curve) GROUP BY hour""",
    "threshold_sweep": w(SCORED, at(str([i / 20 for i in range(21)]))) + """
        SELECT threshold AS prob_threshold, round(sens, 9) AS sens, round(spec, 9) AS spec, round(sens + spec - 1, 9) AS j,
               round(sqrt(pow(1 - sens, 2) + pow(1 - spec, 2)), 9) AS dist FROM r""",
    "confusion_exact": w(SCORED, "counts AS (WITH " + confusion("scored", "hour") + ")", f"""limits AS (
      WITH RECURSIVE cut AS (
        SELECT hour, side, k, n, 0 AS step, 0::DOUBLE AS low, 1::DOUBLE AS high
        FROM (SELECT hour, tp + tn AS k, tp + fp + fn + tn AS n FROM counts), (SELECT unnest(['lower', 'upper']) AS side)
        UNION ALL
        SELECT hour, side, k, n, step + 1, CASE WHEN up THEN mid ELSE low END, CASE WHEN up THEN high ELSE mid END FROM (
          SELECT *, CASE side WHEN 'lower' THEN {tail('k', 'n', 'n', 'mid')} < 0.025 ELSE {tail('0', 'k', 'n', 'mid')} > 0.025 END AS up
          FROM (SELECT *, (low + high) / 2 AS mid FROM cut WHERE step < 45)))
      SELECT hour, max(CASE WHEN side = 'lower' THEN CASE WHEN k = 0 THEN 0 ELSE (low + high) / 2 END END) AS accuracy_lower,
             max(CASE WHEN side = 'upper' THEN CASE WHEN k = n THEN 1 ELSE (low + high) / 2 END END) AS accuracy_upper
      FROM cut WHERE step = 45 GROUP BY hour)""") + f"""
        SELECT hour, tp, fp, fn, tn, round(accuracy_lower, 6) AS accuracy_lower, round(accuracy_upper, 6) AS accuracy_upper,
               round({tail('k', 'n', 'n', 'nir')}, 6) AS p_accuracy_above_nir, round({two_sided('mcnemar')}, 6) AS p_mcnemar
        FROM (SELECT *, tp + tn AS k, tp + fp + fn + tn AS n, greatest(tp + fn, fp + tn) / (tp + fp + fn + tn) AS nir FROM counts) JOIN limits USING (hour)""",
    "gbt_scores": w(FLAGS, "train AS (SELECT * FROM flags WHERE is_train)", boosted("model", "train", "")) + f"""
        SELECT t.encounter_id, t.label::DOUBLE AS label, round(m.score, 9) AS score FROM flags t JOIN model m USING ({CELL}) WHERE NOT t.is_train AND m.round = 3""",
    "gbt_importance": w(FLAGS, "train AS (SELECT * FROM flags WHERE is_train)", """sides AS (
      SELECT unnest(['ed', 'ip', 'long_stay', 'urgency_is_high', 'urgency_is_low']) AS feature, unnest([ed, ip, long_stay, (urgency = 'high')::INTEGER, (urgency = 'low')::INTEGER]) AS value, label FROM train),
      left_over AS (SELECT feature, sum(n * p * (1 - p)) AS rest FROM (SELECT feature, value, count(*) AS n, avg(label::DOUBLE) AS p FROM sides GROUP BY ALL) GROUP BY feature)""") + """
        SELECT feature, 1::DOUBLE AS importance, 100::DOUBLE AS scaled, 1::INTEGER AS rank FROM left_over ORDER BY round(rest, 9), feature LIMIT 1""",
    "gbt_second_order": w(FLAGS, "train AS (SELECT * FROM flags WHERE is_train)", newton("model", "train", "")) + f"""
        SELECT t.encounter_id, t.label::DOUBLE AS label, round(m.score, 9) AS score FROM flags t JOIN model m USING ({CELL}) WHERE NOT t.is_train AND m.round = 3""",
    "gbt_stumps": w(FLAGS, stumps()) + """
        SELECT tree::INTEGER AS tree, unnest([0, 1, 2])::BIGINT AS node, unnest([flag, NULL, NULL]) AS feature, unnest([1::DOUBLE, NULL, NULL]) AS cut, unnest([false, NULL, NULL]) AS missing_left,
               unnest([round(gain, 6), NULL, NULL]) AS gain, unnest([round(hl + hr, 6), round(hl, 6), round(hr, 6)]) AS cover, unnest([NULL, round(left_value, 6), round(right_value, 6)]) AS value FROM trees""",
    "importance_parts": w(FLAGS, stumps(), "parts AS (SELECT flag AS feature, sum(gain) AS total_gain, sum(hl + hr) AS total_cover, count(*) AS splits FROM trees GROUP BY flag)") + """
        SELECT feature, round(total_gain, 6) AS total_gain, round(total_cover, 6) AS total_cover, splits, round(total_gain / sum(total_gain) OVER (), 6) AS gain,
               round(total_cover / sum(total_cover) OVER (), 6) AS cover, round(splits / sum(splits) OVER (), 6) AS frequency FROM parts""",
    "cv_rounds": w(FLAGS, LEFT_OUT, boosted("model", "train", "k, "), f"rated AS (SELECT f.label, m.k, m.round, m.score, CASE WHEN f.fold = m.k THEN 'test' ELSE 'train' END AS part FROM folds f JOIN model m USING ({CELL}))",
                   area("rated", "k, round, part"), """rounds AS (
      SELECT round, avg(c) FILTER (part = 'train') AS train_mean, stddev_samp(c) FILTER (part = 'train') AS train_sd,
             avg(c) FILTER (part = 'test') AS test_mean, stddev_samp(c) FILTER (part = 'test') AS test_sd FROM area GROUP BY round)""") + """
        SELECT round, round(train_mean, 9) AS train_mean, round(train_sd, 9) AS train_sd, round(test_mean, 9) AS test_mean, round(test_sd, 9) AS test_sd,
               round = (SELECT round FROM rounds ORDER BY round(test_mean, 12) DESC, round LIMIT 1) AS chosen FROM rounds""",
    "cv_second_order": w(FLAGS, LEFT_OUT, newton("model", "train", "k, "), f"rated AS (SELECT f.label, m.k, m.round, m.score, CASE WHEN f.fold = m.k THEN 'test' ELSE 'train' END AS part FROM folds f JOIN model m USING ({CELL}))",
                   area("rated", "k, round, part"), """rounds AS (
      SELECT round, avg(c) FILTER (part = 'train') AS train_mean, stddev_samp(c) FILTER (part = 'train') AS train_sd,
             avg(c) FILTER (part = 'test') AS test_mean, stddev_samp(c) FILTER (part = 'test') AS test_sd FROM area GROUP BY round)""") + """
        SELECT round, round(train_mean, 9) AS train_mean, round(train_sd, 9) AS train_sd, round(test_mean, 9) AS test_mean, round(test_sd, 9) AS test_sd,
               round = (SELECT round FROM rounds ORDER BY round(test_mean, 12) DESC, round LIMIT 1) AS chosen FROM rounds""",
    "grid_second_order": w(FLAGS, LEFT_OUT, NEWTON_GRID) + "SELECT * FROM settings",
    "cv_out_of_fold": w(FLAGS, LEFT_OUT, boosted("model", "train", "k, ")) + f"""
        SELECT f.encounter_id, f.fold, f.label::DOUBLE AS label, round(m.score, 9) AS score FROM folds f JOIN model m USING ({CELL}) WHERE m.k = f.fold AND m.round = 3""",
    "cv_grid": w(FLAGS, LEFT_OUT, GRID) + "SELECT * FROM settings",
    "cv_best_setting": w(FLAGS, LEFT_OUT, GRID) + "SELECT * FROM settings ORDER BY roc DESC, rounds, eta LIMIT 1",
    "metric_bundle": w(SCORED, at("[0.1, 0.3, 0.5]", ">")) + """
        SELECT threshold, metric, round(value, 9) AS value FROM (
          SELECT threshold, unnest(['f', 'auc', 'ppv', 'npv', 'sens', 'spec', 'acc', 'err', 'rpp']) AS metric,
                 unnest([2 * tp / nullif(2 * tp + fp + fn, 0), (sens + spec) / 2, ppv, npv, sens, spec, (tp + tn) / (n_pos + n_neg), 1 - (tp + tn) / (n_pos + n_neg), rpp]) AS value FROM r)""",
}
