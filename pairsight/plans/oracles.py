"""DuckDB SQL for the named queries, written independently of the Spark plans."""

from __future__ import annotations

from pairsight import values as V
from pairsight.operators.categorize import CategoryDictionary, RuleTable
from pairsight.plans import demo_tables as D

# Python-style whitespace for an engine whose \s is ASCII only.
WS = (r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
U60 = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"
LINE_KEY = ("md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT), "
            "CAST(round(l_extendedprice * 100) AS BIGINT)))")
RULE = "left_category, right_category, mechanism, risk_level"


def lit(text) -> str:
    return "NULL" if text is None else "'" + str(text).replace("'", "''") + "'"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, (int, float)) else lit(x) for x in r) + ")" for r in rows)


def case(column: str, table: dict, default: str) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items())
    return f"CASE {column} {whens} ELSE {lit(default)} END"


def dictionary_ctes(name: str, source: str, dictionary: CategoryDictionary) -> str:
    """CTE ``name(name, category)`` over the distinct names that ``source`` selects."""
    terms = [(i, c, t) for i, (c, ts) in enumerate(dictionary.entries) for t in ts]
    return f"""
    {name}_names AS (SELECT DISTINCT name FROM ({source})),
    {name}_terms(ord, category, term) AS (VALUES {values(terms)}),
    {name}_hits AS (
      SELECT n.name, t.category, t.ord, count(*) AS hits FROM {name}_names n
      JOIN {name}_terms t ON contains(lower(n.name), t.term) GROUP BY ALL),
    {name}_best AS (
      SELECT name, category FROM {name}_hits
      QUALIFY row_number() OVER (PARTITION BY name ORDER BY hits DESC, ord) = 1),
    {name} AS (
      SELECT n.name, coalesce(b.category, 'other') AS category FROM {name}_names n
      LEFT JOIN {name}_best b ON n.name = b.name)"""


def rules_cte(rules: RuleTable, name: str = "rules") -> str:
    return f"{name}(lc, rc, m, r) AS (VALUES {values(rules.rows)})"


PAIRS = f"""
{dictionary_ctes("lcat", "SELECT p_name AS name FROM part", D.LEFT)},
{dictionary_ctes("rcat", "SELECT c_mktsegment AS name FROM customer", D.RIGHT)},
{rules_cte(D.RULES)},
pairs AS (
  SELECT {LINE_KEY} AS row_id, l_partkey AS left_key, o_custkey AS right_key, l_suppkey,
    p_name AS left_name, c_mktsegment AS right_name, l_linestatus, o_orderstatus,
    CAST(l_returnflag = 'R' AS INT) AS label, l_discount * 10 AS p, CAST(l_discount * 10 > 0.5 AS INT) AS prediction,
    lcat.category AS left_category, rcat.category AS right_category,
    coalesce(m, 'unknown') AS mechanism, coalesce(r, 'LOW') AS risk_level
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN lcat ON lcat.name = p_name JOIN rcat ON rcat.name = c_mktsegment
  LEFT JOIN rules ON lc = lcat.category AND rc = rcat.category)"""


def over_pairs(body: str, more: str = "") -> str:
    return f"WITH {PAIRS}{more} {body}"


def score(prefix: str = "") -> str:
    p = prefix
    return (f"least(CASE {p}risk_level WHEN 'HIGH' THEN 4 WHEN 'MODERATE' THEN 2 ELSE 1 END"
            f" + CASE WHEN {p}mechanism IN ('cyp3a4_inhibition', 'vitamin_k_competition') THEN 1 ELSE 0 END"
            f" + CASE WHEN {p}left_category = 'anticoagulant' AND {p}right_category = 'leafy_greens' THEN 2 ELSE 0 END, 5)")


def title(text: str) -> str:
    return (f"list_aggregate(list_transform(regexp_extract_all({text}, '(\\p{{L}}+|\\P{{L}}+)'), "
            "lambda s: upper(s[1]) || lower(s[2:])), 'string_agg', '')")


def cleaned(text: str) -> str:
    return (f"regexp_replace(regexp_replace(regexp_replace(lower({text}), '^[{WS}]+|[{WS}]+$', '', 'g'), "
            f"'[^a-z{WS}]', '', 'g'), '[{WS}]+', ' ', 'g')")


def clean_query(table: str, left: str, right: str, distinct_after: bool) -> str:
    last = "DISTINCT" if distinct_after else ""
    return f"""
    WITH raw AS (SELECT DISTINCT {left} AS l, {right} AS r FROM {table} WHERE {left} IS NOT NULL AND {right} IS NOT NULL),
    done AS (SELECT {cleaned('l')} AS left_name, {cleaned('r')} AS right_name FROM raw)
    SELECT {last} left_name, right_name, 1 AS label FROM done WHERE length(left_name) > 2 AND length(right_name) > 2"""


BAND = "CASE WHEN {0} > 0.7 THEN 'High' WHEN {0} > 0.4 THEN 'Medium' ELSE 'Low' END"
SIGNIFICANCE = "CASE risk_level WHEN 'HIGH' THEN 'Critical' WHEN 'MODERATE' THEN 'Important' ELSE 'Monitor' END"
PERCENT = "CAST(floor(p * 100 + 0.5) AS BIGINT)"


def evaluation(scored: str) -> str:
    """Metrics over ``scored(label, prediction, p)`` by plain global windows."""
    return f"""
    s AS ({scored}),
    c AS (SELECT count(*) FILTER (label = 0 AND prediction = 0) AS c00, count(*) FILTER (label = 0 AND prediction = 1) AS c01,
      count(*) FILTER (label = 1 AND prediction = 0) AS c10, count(*) FILTER (label = 1 AND prediction = 1) AS c11, count(*) AS n FROM s),
    g AS (SELECT p, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM s GROUP BY p),
    w AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp,
      sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM g),
    k AS (SELECT sum(pos * (nn - fp + neg / 2.0)) / max(CAST(np AS DOUBLE) * nn) AS auc,
      sum(CAST(pos AS DOUBLE) / np * tp / (tp + fp)) AS ap FROM w)
    SELECT n AS n_rows, round((c00 + c11) / n, 6) AS accuracy,
      round((coalesce(c00 / nullif(c00 + c10, 0), 0) * (c00 + c01) + coalesce(c11 / nullif(c11 + c01, 0), 0) * (c10 + c11)) / n, 6) AS precision,
      round((c00 + c11) / n, 6) AS recall,
      round((coalesce(2 * c00 / nullif(2 * c00 + c01 + c10, 0), 0) * (c00 + c01) + coalesce(2 * c11 / nullif(2 * c11 + c01 + c10, 0), 0) * (c10 + c11)) / n, 6) AS f1,
      round(auc, 6) AS roc_auc, round(ap, 6) AS avg_precision FROM c, k"""


DOC_SCORES = ("SELECT quality AS label, CAST(least(n_chars / 5000.0, 1.0) > 0.5 AS INT) AS prediction, "
              "least(n_chars / 5000.0, 1.0) AS p FROM labels JOIN documents USING (doc_id)")


def roc(scored: str, drop: bool) -> str:
    keep = "WHERE rn = 1 OR np_ IS NULL OR np_ <> pos OR nn_ <> neg" if drop else ""
    return f"""
    s AS ({scored}),
    g AS (SELECT CAST(p AS DOUBLE) AS p, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM s GROUP BY 1),
    w AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp, sum(pos) OVER () AS np,
      sum(neg) OVER () AS nn, row_number() OVER (ORDER BY p DESC) AS rn, lead(pos) OVER (ORDER BY p DESC) AS np_,
      lead(neg) OVER (ORDER BY p DESC) AS nn_ FROM g)
    SELECT round(p, 6) AS threshold, CAST(fp AS BIGINT) AS fp, CAST(tp AS BIGINT) AS tp, round(fp / nn, 6) AS fpr,
      round(tp / np, 6) AS tpr FROM w {keep}
    UNION ALL SELECT CAST('Infinity' AS DOUBLE), CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE"""


EDGES = [i * 0.1 for i in range(10)] + [1.0]
BINS = f"""
bins(bin, lo, hi) AS (SELECT * FROM (VALUES {values([(i, EDGES[i], EDGES[i + 1]) for i in range(10)])}) v(bin, lo, hi)),
cal AS (SELECT bin, CAST(lo AS DOUBLE) AS bin_lower, CAST(hi AS DOUBLE) AS bin_upper, avg(label) AS accuracy, avg(p) AS confidence, count(*) AS n
  FROM pairs JOIN bins ON p > CAST(lo AS DOUBLE) AND p <= CAST(hi AS DOUBLE) GROUP BY ALL)"""

FEATURES = f"""
att AS (SELECT vec_id AS row_id, (list_value({', '.join(lit(s) for s in D.FEATURE_STEMS)}))[(i % 6) + 1] || i AS feature,
  abs(x) AS value, CASE WHEN abs(x) < 0.01 THEN 0.0 ELSE x END AS attribution, label % 2 AS prediction
  FROM (SELECT vec_id, label, unnest(list_transform(embedding, lambda e: CAST(e AS DOUBLE))) AS x,
        unnest(range(len(embedding))) AS i FROM embeddings)),
dom AS (SELECT * FROM att WHERE regexp_matches(feature, 'drug_|food_|mechanism_|risk_'))"""


def label_text(f: str = "feature") -> str:
    whens = " ".join(f"WHEN contains({f}, {lit(t)}) THEN {lit(p)} || replace({f}, {lit(t)}, '')" for t, p in V.FEATURE_TOKENS)
    return f"CASE {whens} ELSE {f} END"


TOKENS = f"""
kept AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
  lambda t: NOT list_contains([{', '.join(lit(w) for w in D.STOP_WORDS)}], t)) AS k FROM documents),
terms AS (SELECT doc_id, unnest(list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]))) AS term FROM kept),
vocab AS (SELECT term FROM terms GROUP BY term ORDER BY count(*) DESC, term LIMIT 50),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms SEMI JOIN vocab USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term)"""

DIRTY = f"""
dirty AS (SELECT {LINE_KEY} AS row_id,
  CASE WHEN l_discount = 0 THEN CAST('Infinity' AS DOUBLE) WHEN l_discount > 0.09 THEN CAST('-Infinity' AS DOUBLE) ELSE l_discount END AS f1,
  CASE WHEN l_tax = 0 THEN CAST('NaN' AS DOUBLE) WHEN l_tax > 0.07 THEN NULL ELSE l_tax END AS f2 FROM lineitem)"""

EVENTS = f"""
{dictionary_ctes("lcat", "SELECT event_type AS name FROM events UNION SELECT ''", D.EVENT_LEFT)},
{dictionary_ctes("rcat", "SELECT json_extract_string(props, '$.k') AS name FROM events UNION SELECT ''", D.EVENT_RIGHT)},
{rules_cte(D.EVENT_RULES)},
req AS (SELECT event_id, ts,
  CASE WHEN value >= 4 AND value < 6 THEN '' ELSE event_type END AS left_name,
  CASE WHEN value < 6 THEN '' ELSE json_extract_string(props, '$.k') END AS right_name FROM events),
enriched AS (SELECT event_id, ts, left_name, right_name, lcat.category AS left_category, rcat.category AS right_category,
  coalesce(m, 'unknown') AS mechanism, coalesce(r, 'LOW') AS risk_level
  FROM req JOIN lcat ON lcat.name = left_name JOIN rcat ON rcat.name = right_name
  LEFT JOIN rules ON lc = lcat.category AND rc = rcat.category)"""

NEGATIVES = f""",
known AS (SELECT DISTINCT left_key, right_key FROM pairs),
le AS (SELECT left_key, left_name, left_category, row_number() OVER (ORDER BY md5(CAST(left_key AS VARCHAR)), left_key) - 1 AS pos
  FROM (SELECT DISTINCT left_key, left_name, left_category FROM pairs)),
re AS (SELECT right_key, right_name, right_category, row_number() OVER (ORDER BY md5(CAST(right_key AS VARCHAR)), right_key) - 1 AS pos
  FROM (SELECT DISTINCT right_key, right_name, right_category FROM pairs)),
target AS (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) AS n FROM pairs),
ids AS (SELECT unnest(range(20 * n)) AS id FROM target),
draws AS (SELECT id, {U60.format("'42|left|' || id")} % (SELECT count(*) FROM le) AS lp,
  {U60.format("'42|right|' || id")} % (SELECT count(*) FROM re) AS rp,
  {U60.format("'42|accept|' || id")} / 1152921504606846976.0::DOUBLE AS u FROM ids),
tried AS (SELECT id AS draw_id, le.left_key, re.right_key, left_name, right_name, left_category, right_category,
  coalesce(m, 'unknown') AS mechanism, coalesce(r, 'LOW') AS risk_level, u
  FROM draws JOIN le ON lp = le.pos JOIN re ON rp = re.pos LEFT JOIN rules ON lc = left_category AND rc = right_category),
negatives AS (SELECT draw_id, left_key, right_key, left_name, right_name, {RULE}, 0 AS label
  FROM tried ANTI JOIN known USING (left_key, right_key)
  WHERE u < CASE WHEN mechanism = 'unknown' THEN 0.9 WHEN risk_level = 'HIGH' THEN 0.2 WHEN risk_level = 'MODERATE' THEN 0.4 ELSE 0.7 END
  ORDER BY draw_id LIMIT (SELECT n FROM target))"""

COUNTERFACTUALS = f""",
opts(ord, side, alt) AS (VALUES {values(
    [(i, 'L', c) for i, c in enumerate(D.LEFT.names)] + [(len(D.LEFT.names) + i, 'R', c) for i, c in enumerate(D.RIGHT.names)])}),
base AS (SELECT DISTINCT {RULE} FROM pairs),
alts AS (SELECT left_category, right_category, ord, risk_level AS original_risk,
  CASE side WHEN 'L' THEN 'Using a ' || alt || ' medication instead' ELSE 'Consuming a ' || alt || ' food instead' END AS scenario,
  coalesce(m, 'unknown') AS mechanism_change, coalesce(r, 'LOW') AS counterfactual_risk
  FROM base JOIN opts ON alt <> CASE side WHEN 'L' THEN left_category ELSE right_category END
  LEFT JOIN rules ON lc = CASE side WHEN 'L' THEN alt ELSE left_category END AND rc = CASE side WHEN 'L' THEN right_category ELSE alt END),
changed AS (SELECT *, CASE WHEN counterfactual_risk = 'HIGH' AND original_risk <> 'HIGH' THEN 'INCREASED'
  WHEN counterfactual_risk = 'LOW' AND original_risk <> 'LOW' THEN 'DECREASED' ELSE 'SAME' END AS risk_change FROM alts),
cf AS (SELECT *, CAST(row_number() OVER (PARTITION BY left_category, right_category ORDER BY
  CASE risk_change WHEN 'INCREASED' THEN 2 WHEN 'SAME' THEN 1 ELSE 0 END DESC, ord) AS INT) AS rank FROM changed QUALIFY rank <= 5)"""


def batch(limit: str) -> str:
    return over_pairs(
        f"SELECT combo_id, left_name, right_name, {score()} / 5.0 > 0.5 AS interaction_predicted, {score()} / CAST(5 AS DOUBLE) AS probability, risk_level FROM combos {limit}",
        """,
        ln AS (SELECT name, category, row_number() OVER (ORDER BY md5(name), name) - 1 AS pos FROM lcat),
        rn AS (SELECT name, category, row_number() OVER (ORDER BY md5(name), name) - 1 AS pos FROM rcat),
        combos AS (SELECT ln.pos * (SELECT count(*) FROM rn) + rn.pos AS combo_id, ln.name AS left_name, rn.name AS right_name,
          ln.category AS left_category, rn.category AS right_category, coalesce(m, 'unknown') AS mechanism, coalesce(r, 'LOW') AS risk_level
          FROM ln CROSS JOIN rn LEFT JOIN rules ON lc = ln.category AND rc = rn.category)""")


def hot(column: str, labels, prefix: str) -> str:
    return ", ".join(f"CAST({column} = {lit(v)} AS INT) AS {prefix}_{v}" for v in sorted(labels))


BASKETS = f""",
bl AS (SELECT DISTINCT l_suppkey AS basket_id, left_name, left_category FROM pairs),
br AS (SELECT DISTINCT l_suppkey AS basket_id, right_name, right_category FROM pairs),
alert AS (SELECT DISTINCT {RULE}, {score()} / CAST(5 AS DOUBLE) AS probability FROM pairs WHERE {score()} / 5.0 > 0.5),
hits AS (SELECT bl.basket_id, left_name, right_name, mechanism, risk_level, probability FROM bl
  JOIN br ON bl.basket_id = br.basket_id JOIN alert ON alert.left_category = bl.left_category AND alert.right_category = br.right_category)"""

TARGETS = f", targets AS (SELECT DISTINCT left_name, right_name, {RULE} FROM pairs)"
MAXIMUM = "CAST(5 AS DOUBLE)"


def correlations() -> str:
    columns = {f"drug_{c}": f"left_category = {lit(c)}" for c in D.LEFT.labels}
    columns |= {f"mechanism_{m}": f"mechanism = {lit(m)}" for m in D.RULES.mechanisms}
    columns |= {f"risk_{r}": f"risk_level = {lit(r)}" for r in sorted(V.RISK_LEVELS)}
    names = list(columns)
    flags = ", ".join(f"CAST({test} AS INT) AS {n}" for n, test in columns.items())
    parts = [f"SELECT {lit(a)} AS feature1, {lit(b)} AS feature2, corr({a}, {b}) AS correlation FROM wide"
             for i, a in enumerate(names) for b in names[i + 1:]]
    return over_pairs(
        "SELECT feature1, feature2, round(correlation, 6) AS correlation FROM r WHERE correlation IS NOT NULL AND NOT isnan(correlation) "
        "AND abs(correlation) > 0.7 ORDER BY round(abs(correlation), 9) DESC, feature1, feature2 LIMIT 5",
        f", wide AS (SELECT {flags} FROM pairs), r AS ({' UNION ALL '.join(parts)})")


def synthetic() -> str:
    def pick(names, side):
        return f"(list_value({', '.join(lit(n) for n in names)}))[{U60.format(f'{lit(f'42|{side}|')} || o_orderkey')} % {len(names)} + 1]"

    return (f"SELECT o_orderkey AS id, {pick(V.SYNTHETIC_LEFT, 'left')} AS drug, "
            f"{pick(V.SYNTHETIC_RIGHT, 'right')} AS food FROM orders")


def details(fields: list[str]) -> str:
    return ", ".join(
        case("mechanism", {k: v[i] for k, v in V.MECHANISM_DETAILS.items()}, V.MECHANISM_DETAILS_DEFAULT[i]) + f" AS {f}"
        for i, f in enumerate(fields))


def monitoring() -> str:
    exact = {f"{r}|{m}": a for r, m, a in V.MONITORING if m != "default"}
    level = {r: a for r, m, a in V.MONITORING if m == "default"}
    inner = case("risk_level", level, V.MONITORING_DEFAULT)
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in exact.items())
    return f"CASE risk_level || '|' || mechanism {whens} ELSE {inner} END"


def alternative(i: int, name: str) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(','.join(v[i]))}" for k, v in D.ALTERNATIVES.items())
    return f"CASE lower({name}) {whens} END"


def alternative_message(name: str) -> str:
    known = ", ".join(lit(k) for k in D.ALTERNATIVES)
    return f"CASE WHEN lower({name}) IN ({known}) THEN NULL ELSE {lit(V.ALTERNATIVES_DEFAULT)} END"


def action(i: int) -> str:
    return case("risk_level", {k: v[i] for k, v in V.RISK_ACTIONS.items()}, V.RISK_ACTIONS["LOW"][i])


EXPLANATION = case("mechanism", V.MECHANISM_TEXT, V.MECHANISM_TEXT["unknown"])
RECOMMENDATION = case("risk_level", V.RISK_TEXT, V.RISK_TEXT["LOW"])
JACCARD = ("round(len(list_intersect(list_distinct(string_split({0}, '')), list_distinct(string_split({1}, '')))) / "
           "greatest(len(list_distinct(list_concat(string_split({0}, ''), string_split({1}, '')))), 1), 6)")


def large_categories() -> str:
    fixed = [(i, c, t) for i, (c, ts) in enumerate(D.LEFT.entries) for t in ts]
    topic = U60.format("w") + " % 40"
    return f"""
WITH words AS (
  SELECT DISTINCT w FROM (
    SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[a-z]+')) AS w FROM documents)
  WHERE length(w) BETWEEN 4 AND 12),
terms(ord, category, term) AS (
  SELECT * FROM (VALUES {values(fixed)})
  UNION ALL SELECT CAST({len(D.LEFT.entries)} + {topic} AS INTEGER), 'topic_' || CAST({topic} AS VARCHAR), w FROM words),
names AS (SELECT DISTINCT p_name AS name FROM part),
hits AS (SELECT n.name, t.category, t.ord, count(*) AS hits FROM names n JOIN terms t ON contains(lower(n.name), t.term) GROUP BY ALL),
best AS (SELECT name, category FROM hits QUALIFY row_number() OVER (PARTITION BY name ORDER BY hits DESC, ord) = 1)
SELECT p_partkey, p_name, coalesce(b.category, 'other') AS category FROM part LEFT JOIN best b ON b.name = p_name"""


def oracle_sql() -> dict[str, str]:
    sql = {
        "categorize_large": large_categories(),
        "src_pairs_csv": over_pairs("SELECT left_name AS drug, right_name AS food FROM pairs"),
        "src_labelled": over_pairs(
            "SELECT left_name AS drug, right_name AS food, label AS interaction, left_category AS drug_category, "
            "right_category AS food_category, mechanism, risk_level FROM pairs"),
        "src_curated_json": over_pairs(
            f"SELECT DISTINCT left_name AS drug, right_name AS food, risk_level, mechanism, {EXPLANATION} AS explanation, "
            f"{RECOMMENDATION} AS recommendations FROM pairs"),
        "src_synthetic_pairs": synthetic(),
        "req_decode_validate":
            "SELECT event_id, CASE WHEN value >= 4 AND value < 6 THEN '' ELSE event_type END AS left_name, "
            "CASE WHEN value < 6 THEN '' ELSE json_extract_string(props, '$.k') END AS right_name, "
            "CASE WHEN value < 6 THEN 'Both drug and food must be provided' END AS error FROM events",
        "result_envelope": over_pairs(
            "SELECT row_id, CASE WHEN label = 1 THEN '{\"success\":true,\"data\":' || body || '}' ELSE failed END AS envelope, "
            "CASE WHEN label = 1 THEN body ELSE failed END AS payload FROM b",
            f""", b AS (SELECT row_id, label,
              '{{"drug":"' || left_name || '","food":"' || right_name || '","percent":' || {PERCENT} || ',"risk_level":"' || risk_level || '"}}' AS body,
              '{{"success":false,"error":"no result for ' || left_name || '"}}' AS failed FROM pairs)"""),
        "clean_pairs": clean_query("documents", "text", "source", False),
        "clean_pairs_distinct": clean_query("conversations", "text", "role", True),
        "clean_text": f"SELECT conv_id, turn, {cleaned('text')} AS cleaned FROM conversations",
        "swapped_pairs": over_pairs(
            """SELECT a.o_orderstatus AS first_name, a.l_linestatus AS second_name, a.n AS n_forward, b.n AS n_reversed
            FROM c a JOIN c b ON a.o_orderstatus = b.l_linestatus AND a.l_linestatus = b.o_orderstatus
            WHERE a.o_orderstatus < a.l_linestatus""",
            ", c AS (SELECT o_orderstatus, l_linestatus, count(*) AS n FROM pairs GROUP BY ALL)"),
        "categorize_left": over_pairs("SELECT row_id, left_name, left_category FROM pairs"),
        "categorize_right": over_pairs("SELECT row_id, right_name, right_category FROM pairs"),
        "rule_join": over_pairs(f"SELECT row_id, {RULE} FROM pairs"),
        "rule_join_table": over_pairs(f"SELECT row_id, {RULE} FROM pairs"),
        "risk_score": over_pairs(f"SELECT row_id, CAST({score()} AS INT) AS risk_score FROM pairs"),
        "search_entities": """
            SELECT * FROM (SELECT DISTINCT 'left' AS side, p_name AS name FROM part WHERE contains(lower(p_name), 'old') ORDER BY name LIMIT 20)
            UNION ALL SELECT * FROM (SELECT DISTINCT 'right' AS side, c_name AS name FROM customer WHERE contains(lower(c_name), '99') ORDER BY name LIMIT 20)""",
        "known_override": over_pairs(
            """SELECT p.row_id, CASE WHEN k.label IS NULL THEN p.p > 0.5 ELSE k.label = 1 END AS interaction_predicted,
            CASE WHEN k.label IS NULL THEN p.p ELSE CAST(k.label AS DOUBLE) END AS probability,
            CASE WHEN k.label IS NULL THEN 'model_prediction' ELSE 'known_database' END AS source,
            coalesce(k.left_category, p.left_category) AS left_category, coalesce(k.right_category, p.right_category) AS right_category,
            coalesce(k.mechanism, p.mechanism) AS mechanism, coalesce(k.risk_level, p.risk_level) AS risk_level
            FROM pairs p LEFT JOIN k ON lower(p.left_name) = lower(k.left_name) AND lower(p.right_name) = lower(k.right_name)""",
            """, k AS (SELECT * FROM pairs WHERE risk_level = 'HIGH'
            QUALIFY row_number() OVER (PARTITION BY lower(left_name), lower(right_name) ORDER BY row_id) = 1)"""),
        "similar_strict": over_pairs(
            """SELECT t.left_name, t.right_name, CAST(rank AS INT) AS rank, f.left_name AS similar_left_name, f.right_name AS similar_right_name,
            f.label AS similar_label, f.risk_level AS similar_risk_level
            FROM targets t JOIN f ON t.left_category = f.left_category AND t.right_category = f.right_category""",
            TARGETS + """, f AS (SELECT *, row_number() OVER (PARTITION BY left_category, right_category ORDER BY row_id) AS rank
            FROM pairs QUALIFY rank <= 5)"""),
        "similar_loose": over_pairs(
            """SELECT t.left_name, t.right_name, CAST(rank AS INT) AS rank, f.left_name AS similar_left_name, f.right_name AS similar_right_name,
            f.risk_level AS similar_risk_level
            FROM targets t JOIN f ON t.left_category = f.lc AND t.right_category = f.rc""",
            TARGETS + """, asked AS (SELECT DISTINCT left_category AS lc, right_category AS rc FROM targets),
            f AS (SELECT asked.lc, asked.rc, p.*, row_number() OVER (PARTITION BY asked.lc, asked.rc ORDER BY row_id) AS rank
            FROM asked JOIN pairs p ON (p.left_category = asked.lc OR p.right_category = asked.rc) AND p.label = 1 QUALIFY rank <= 3)"""),
        "explained_pairs": over_pairs(
            f"""SELECT t.left_name, t.right_name, {score()} / {MAXIMUM} AS probability, {details(['description', 'clinical_impact', 'timing'])},
            f.similar, {BAND.format(f'{score()} / {MAXIMUM}')} AS confidence_level, {SIGNIFICANCE} AS clinical_significance
            FROM targets t JOIN f USING (left_category, right_category)""",
            TARGETS + """, first3 AS (SELECT *, row_number() OVER (PARTITION BY left_category, right_category ORDER BY row_id) AS rank
            FROM pairs QUALIFY rank <= 3),
            f AS (SELECT left_category, right_category,
              string_agg(concat_ws('/', left_name, right_name, label, risk_level), ';' ORDER BY rank) AS similar FROM first3 GROUP BY ALL)"""),
        "batch_cross_score": batch("ORDER BY combo_id LIMIT 100"),
        "batch_cross_all": batch(""),
        "batch_summary": "SELECT count(*) AS total_combinations, count(*) FILTER (interaction_predicted) AS interactions_found FROM ("
                         + batch("") + ")",
        "basket_compat": over_pairs(
            """SELECT b.basket_id, coalesce(n, 0) = 0 AS safe, coalesce(n, 0) AS n_interactions,
            'Found ' || coalesce(n, 0) || ' potential interactions' AS recommendations
            FROM (SELECT DISTINCT basket_id FROM bl) b LEFT JOIN (SELECT basket_id, count(*) AS n FROM hits GROUP BY 1) h USING (basket_id)""",
            BASKETS),
        "basket_alerts": over_pairs("SELECT * FROM hits", BASKETS),
        "counterfactual_rules": over_pairs(
            "SELECT row_id, rank, scenario, original_risk, counterfactual_risk, risk_change, mechanism_change "
            "FROM pairs JOIN cf USING (left_category, right_category)", COUNTERFACTUALS),
        "counterfactual_summary": over_pairs(
            """SELECT left_category, right_category, n_pairs,
            coalesce(string_agg(scenario, ';' ORDER BY rank) FILTER (risk_change = 'DECREASED'), '') AS safer_alternatives,
            coalesce(string_agg(scenario, ';' ORDER BY rank) FILTER (risk_change = 'INCREASED'), '') AS riskier_alternatives,
            coalesce(string_agg(scenario, ';' ORDER BY rank) FILTER (risk_change = 'SAME'), '') AS similar_risk
            FROM (SELECT left_category, right_category, count(*) AS n_pairs FROM pairs GROUP BY ALL) JOIN cf USING (left_category, right_category)
            GROUP BY ALL""", COUNTERFACTUALS),
        "advice_enrich": over_pairs(
            f"""SELECT {RULE}, p > 0.5 AS interaction_predicted, count(*) AS n_pairs, {EXPLANATION} AS explanation, {RECOMMENDATION} AS recommendation,
            {case('risk_level', V.SHORT_ADVICE, V.SHORT_ADVICE_DEFAULT)} AS short_advice,
            CASE WHEN p > 0.5 THEN {lit(V.ICON_ALERT)} ELSE {lit(V.ICON_OK)} END AS icon,
            CASE WHEN mechanism = 'unknown' THEN 'Not fully understood' ELSE {title("replace(mechanism, '_', ' ')")} END AS mechanism_text,
            {case('mechanism', V.MECHANISM_EDUCATION, V.MECHANISM_EDUCATION_DEFAULT)} AS patient_explanation,
            'Mechanism: ' || mechanism || ', Category interaction: ' || left_category || ' + ' || right_category AS professional_details
            FROM pairs GROUP BY ALL"""),
        "mechanism_details": over_pairs(
            f"SELECT left_category, right_category, mechanism, count(*) AS n_pairs, {details(['description', 'clinical_impact', 'timing'])} FROM pairs GROUP BY ALL"),
        "monitoring_advice": over_pairs(f"SELECT row_id, {monitoring()} AS monitoring_advice FROM pairs"),
        "alternatives": f"SELECT p_partkey, {alternative(0, 'p_name')} AS avoid, {alternative(1, 'p_name')} AS safer, {alternative_message('p_name')} AS message FROM part",
        "decision_pathway": over_pairs(
            f"""SELECT row_id, {title('left_name')} AS left_title, {title('right_name')} AS right_title,
            CASE WHEN p > 0.7 THEN 'INTERACTION' ELSE 'NO INTERACTION' END AS decision, printf('%.3f', p) AS confidence, {RULE} FROM pairs"""),
        "decision_support": over_pairs(
            f"""SELECT {title('left_name')} AS left_title, {title('right_name')} AS right_title, risk_level,
            {case('mechanism', V.MECHANISM_PLAIN, V.MECHANISM_PLAIN_DEFAULT)} AS simple_explanation, {action(0)} AS message,
            {action(1)} AS action, {action(2)} AS timeline, mechanism, printf('%.3f', {score()} / {MAXIMUM}) AS confidence,
            {monitoring()} AS monitoring_advice, {alternative(1, 'left_name')} AS safer, {alternative_message('left_name')} AS alternatives_message
            FROM targets""", TARGETS),
        "case_studies": over_pairs(
            f"""SELECT {title('left_name')} || '-' || {title('right_name')} || ' Interaction' AS case_name, count(*) AS n_pairs,
            CASE WHEN round(avg(p), 6) > 0.5 THEN 'INTERACTION' ELSE 'NO INTERACTION' END AS decision, round(avg(p), 6) AS p, {RULE}
            FROM pairs GROUP BY left_name, right_name, {RULE}"""),
        "pair_stats": over_pairs(
            "SELECT count(*) AS total_rows, count(DISTINCT left_name) AS unique_left, count(DISTINCT right_name) AS unique_right, count(*) > 0 AS loaded FROM pairs"),
        "category_counts": over_pairs(
            """SELECT * FROM (SELECT 'left' AS side, left_category AS value, count(*) AS n FROM pairs GROUP BY ALL ORDER BY n DESC, value LIMIT 10)
            UNION ALL SELECT * FROM (SELECT 'right' AS side, right_category AS value, count(*) AS n FROM pairs GROUP BY ALL ORDER BY n DESC, value LIMIT 10)"""),
        "risk_distribution": over_pairs(
            "SELECT count(*) FILTER (risk_level = 'HIGH') AS high_count, count(*) FILTER (risk_level = 'MODERATE') AS moderate_count, "
            "count(*) FILTER (risk_level = 'LOW') AS low_count FROM pairs"),
        "risk_map": over_pairs(
            """SELECT '{' || string_agg('"' || risk_level || '":' || n, ',' ORDER BY risk_level) || '}' AS risk_distribution
            FROM (SELECT risk_level, count(*) AS n FROM pairs GROUP BY 1)"""),
        "class_weights": over_pairs(
            """SELECT label, count(*) AS n, (SELECT count(*) FROM pairs) / (2 * count(*)) AS weight,
            (SELECT count(*) FILTER (label = 0) / count(*) FILTER (label = 1) FROM pairs) AS ratio FROM pairs GROUP BY label"""),
        "probability_bands": over_pairs(
            "SELECT count(*) FILTER (p > 0.7) AS high_risk, count(*) FILTER (p > 0.3 AND p <= 0.7) AS medium_risk, "
            "count(*) FILTER (p <= 0.3) AS low_risk FROM pairs"),
        "feature_audit": f"""WITH {DIRTY} SELECT count(*) AS n_rows, CAST(2 AS BIGINT) AS n_features,
            count(*) FILTER (f1 IS NULL OR isnan(f1)) + count(*) FILTER (f2 IS NULL OR isnan(f2)) AS n_missing,
            count(*) FILTER (isinf(f1)) + count(*) FILTER (isinf(f2)) AS n_infinite FROM dirty""",
        "scrub_features": f"""WITH {DIRTY} SELECT row_id, CASE WHEN isfinite(f1) THEN f1 ELSE 0.0 END AS f1,
            CASE WHEN isfinite(f2) THEN f2 ELSE 0.0 END AS f2 FROM dirty""",
        "feature_correlations": correlations(),
        "calibration_bins": over_pairs(
            "SELECT bin, bin_lower, bin_upper, round(accuracy, 6) AS accuracy, round(confidence, 6) AS confidence, n FROM cal", "," + BINS),
        "calibration_error": over_pairs(
            """SELECT (SELECT count(*) FROM pairs) AS n_rows, count(*) AS n_bins,
            round(avg(abs(accuracy - confidence)), 6) AS expected_calibration_error, CAST(NULL AS VARCHAR) AS error FROM cal""", "," + BINS),
        "uncertainty_summary": over_pairs(
            """SELECT left_key, count(*) AS n_replicates, round(avg(p), 6) AS mean_probability, round(stddev_pop(p), 6) AS std_probability,
            round(quantile_cont(p, 0.025), 6) AS ci_lower, round(quantile_cont(p, 0.975), 6) AS ci_upper,
            round(avg(prediction), 6) AS prediction_stability,
            CASE WHEN stddev_pop(p) > 0.2 THEN 'HIGH' WHEN stddev_pop(p) > 0.1 THEN 'MEDIUM' ELSE 'LOW' END AS uncertainty_level
            FROM pairs GROUP BY left_key"""),
        "metrics": over_pairs("", "," + evaluation("SELECT label, prediction, p FROM pairs")),
        "metrics_documents": "WITH " + evaluation(DOC_SCORES),
        "confusion": over_pairs(
            """SELECT CAST(l AS INT) AS label, CAST(q AS INT) AS prediction, count(label) AS n
            FROM (VALUES (0), (1)) a(l) CROSS JOIN (VALUES (0), (1)) b(q) LEFT JOIN pairs ON label = l AND prediction = q GROUP BY ALL"""),
        "roc_points": "WITH " + roc(DOC_SCORES, True),
        "roc_points_all": over_pairs("", "," + roc("SELECT label, p FROM pairs", False)),
        "minmax_score": """SELECT p_partkey, round((p_retailprice - lo) / (hi - lo), 6) AS score FROM part,
            (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)""",
        "soft_vote": f"""SELECT row_id, round(v, 6) AS p_vote, CAST(v > 0.5 AS INT) AS vote FROM (
            SELECT {LINE_KEY} AS row_id, (l_discount * 10 + l_tax * 12.5 + l_quantity / 50) / 3.0 AS v FROM lineitem)""",
        "negatives": over_pairs(f"SELECT draw_id, left_key, right_key, left_name, right_name, {RULE}, label FROM negatives", NEGATIVES),
        "labelled_union": over_pairs(
            f"""SELECT label, {RULE}, count(*) AS n FROM (SELECT 1 AS label, {RULE} FROM pairs
            UNION ALL SELECT label, {RULE} FROM negatives) GROUP BY ALL""", NEGATIVES),
        "stratified_split": over_pairs(
            """SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || row_id))
            <= round(0.2 * count(*) OVER (PARTITION BY label)) AS is_test FROM pairs"""),
        "hash_sample": over_pairs("SELECT row_id, left_name, right_name FROM pairs ORDER BY md5('42|' || row_id), row_id LIMIT 100"),
        "name_jaccard": f"SELECT c_custkey, {JACCARD.format('c_name', 'c_mktsegment')} AS name_similarity FROM customer",
        "pair_features": over_pairs(
            f"""SELECT row_id, left_name || ' ' || right_name AS combined_text, CAST({score()} AS INT) AS risk_score,
            CAST(length(left_name) AS INT) AS drug_length, CAST(length(right_name) AS INT) AS food_length,
            {JACCARD.format('left_name', 'right_name')} AS name_similarity,
            CAST(left_category = right_category AS INT) AS same_category,
            CAST(left_category = 'other' AND right_category = 'other' AS INT) AS both_other FROM pairs"""),
        "title_case": f"SELECT page_id, {title('url')} AS title FROM pages",
        "confidence_band": over_pairs(f"SELECT row_id, {BAND.format('p')} AS confidence_level, {SIGNIFICANCE} AS clinical_significance FROM pairs"),
        "display_row": over_pairs(
            f"SELECT row_id, {PERCENT} AS percent, "
            f"list_aggregate(list_transform(string_split(mechanism, '_'), lambda s: upper(s[1]) || s[2:]), 'string_agg', ' ') AS mechanism_text, "
            "lower(risk_level) AS risk_class FROM pairs"),
        "personal_adjust": """WITH c AS (SELECT c_custkey, c_nationkey * 4 AS age, abs(c_acctbal) / 10000.0 AS p,
            c_acctbal > 5000 AS liver, c_acctbal > 0 AND c_acctbal < 7500 AS kidney, c_acctbal > 0 AS listed FROM customer)
            SELECT c_custkey, round(least(p * (1 + CASE WHEN age > 65 THEN 0.2 ELSE 0 END + CASE WHEN liver THEN 0.3 ELSE 0 END
              + CASE WHEN kidney THEN 0.2 ELSE 0 END), 1), 8) AS adjusted_probability,
            'Risk adjusted for age: ' || age || ', conditions: ' || CASE WHEN listed THEN '[' || concat_ws(', ',
              CASE WHEN liver THEN '''liver_disease''' END, CASE WHEN kidney THEN '''kidney_disease''' END) || ']' ELSE 'None' END AS personalized_warning
            FROM c""",
        "feature_labels": f"WITH {FEATURES} SELECT feature, {label_text()} AS label_text, count(*) AS n FROM att GROUP BY ALL",
        "one_hot": over_pairs(f"SELECT row_id, {hot('left_category', D.LEFT.labels, 'drug')}, {hot('risk_level', V.RISK_LEVELS, 'risk')} FROM pairs"),
        "align_features": over_pairs(
            "SELECT row_id, CAST(left_category = 'age' AS INT)::DOUBLE AS drug_age, 0.0::DOUBLE AS drug_heavy, "
            "CAST(left_category = 'thermal' AS INT)::DOUBLE AS drug_thermal FROM pairs"),
        "standardize": f"""SELECT {LINE_KEY} AS row_id, round((l_quantity - mq) / sq, 6) AS l_quantity_scaled,
            round((l_extendedprice - me) / se, 6) AS l_extendedprice_scaled FROM lineitem,
            (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS me, stddev_pop(l_extendedprice) AS se FROM lineitem)""",
        "tfidf_terms": f"WITH {TOKENS} SELECT term, df, round(idf, 6) AS idf FROM df",
        "tfidf_weights": f"""WITH {TOKENS} SELECT doc_id, term, round(tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)), 6) AS weight
            FROM tf JOIN df USING (term)""",
        "attribution_topk": f"""WITH {FEATURES} SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY abs(attribution) DESC, feature) AS INT) AS rank,
            feature, {label_text()} AS label_text, value, attribution FROM dom WHERE abs(attribution) > 0 QUALIFY rank <= 5""",
        "global_importance": f"""WITH {FEATURES} SELECT feature, round(avg(abs(attribution)), 6) AS importance FROM dom GROUP BY feature
            ORDER BY avg(abs(attribution)) DESC, feature LIMIT 15""",
        "importance_summary": f"""WITH {FEATURES},
            best AS (SELECT feature, avg(abs(attribution)) AS v FROM dom GROUP BY feature ORDER BY v DESC, feature LIMIT 5)
            SELECT count(*) FILTER (contains(feature, 'drug_')) AS left_features, count(*) FILTER (contains(feature, 'food_')) AS right_features,
            count(*) FILTER (contains(feature, 'risk_') OR contains(feature, 'mechanism_')) AS interaction_features,
            (SELECT string_agg(feature, ',' ORDER BY v DESC, feature) FROM (SELECT * FROM best ORDER BY v DESC, feature LIMIT 3)) AS top_features FROM best""",
        "feature_counterfactuals": f"""WITH {FEATURES} SELECT row_id,
            CAST(row_number() OVER (PARTITION BY row_id ORDER BY CASE prediction WHEN 1 THEN attribution ELSE -attribution END DESC, feature) AS INT) AS rank,
            CASE prediction WHEN 1 THEN 'INTERACTION' ELSE 'NO INTERACTION' END AS current_prediction,
            CASE prediction WHEN 1 THEN 'NO INTERACTION' ELSE 'INTERACTION' END AS target_prediction, feature, value AS current_value,
            CASE WHEN attribution > 0 THEN 'decrease' ELSE 'increase' END AS suggested_direction, abs(attribution) AS impact_magnitude
            FROM dom QUALIFY rank <= 3""",
        "dependence_points": f"""WITH {FEATURES}, best AS (SELECT feature FROM att GROUP BY feature ORDER BY avg(abs(attribution)) DESC, feature LIMIT 3)
            SELECT feature, row_id, value, attribution FROM att SEMI JOIN best USING (feature)""",
        "stream_rule_enrich": f"""WITH {EVENTS} SELECT event_id, left_name, right_name, {RULE},
            CASE WHEN left_name <> '' AND right_name <> '' THEN {score()} / {MAXIMUM} END AS probability FROM enriched""",
        "sink_model_package": over_pairs(
            f"SELECT DISTINCT upper(left_name) AS left, ' ' || right_name AS right, {RULE}, true AS same_score FROM pairs"),
        "score_pairs": over_pairs(
            f"""SELECT DISTINCT upper(left_name) AS left, ' ' || right_name AS right, {RULE}, 'model_prediction' AS source,
            {RECOMMENDATION} AS recommendation, true AS consistent FROM pairs"""),
        "svd_text": """SELECT doc_id, 10 AS n_components, true AS shorter, true AS orthonormal, true AS falling FROM documents""",
        "stream_risk_counts": f"""WITH {EVENTS} SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, risk_level, count(*) AS n FROM enriched
            GROUP BY ALL""",
    }
    return {name: text.strip() for name, text in sql.items()}
