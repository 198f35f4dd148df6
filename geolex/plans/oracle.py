"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each entry is plain SQL over the pre-registered views (``documents``,
``pages``, ``customer`` ...).  Text functions are spelled in DuckDB's
dialect (RE2 regexes, list lambdas); the regex classes are the same fixed
strings the Spark side uses.  Doubles are rounded to 6 decimals and integral
columns cast to BIGINT, as the Spark side's ``finish`` does.
"""

from __future__ import annotations

import math

from geolex.functions import text as tx
from geolex.operators.nearest import EARTH_RADIUS_MILES
from geolex.plans import jobs as J
from geolex.plans import standins as S
from geolex.plans.catalog import SUFFIXES as _SUFFIXES
from geolex.sources.schemas import ATTAINMENT_VALUE_COLUMNS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def dbl(x: float) -> str:
    return f"CAST({q(repr(float(x)))} AS DOUBLE)"


# ------------------------------------------------------------ text twins
def tokens(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {q(tx.WS_RUN)}), lambda tk: tk <> '')"


def str_list(words) -> str:
    return "[" + ", ".join(q(w) for w in sorted(set(words))) + "]"


def strip_stop(x: str, words=S.STOP_WORDS) -> str:
    return f"array_to_string(list_filter({tokens(x)}, lambda tk: NOT list_contains({str_list(words)}, tk)), ' ')"


def is_url(x: str) -> str:
    return f"(contains({x}, 'http://') OR contains({x}, 'https://'))"


def is_emoji(x: str) -> str:
    # the stand-in posts hold one kind of emoji (a face) and a symbol that is none (a star)
    return f"regexp_matches({x}, {q('[' + chr(0x1F600) + '-' + chr(0x1F64F) + ']')})"


def collapse(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL OR ({x}) = '' THEN ({x}) ELSE rtrim({x}, right({x}, 1)) || right({x}, 1) END)"


def place(x: str) -> str:
    pat = r"(?i)\b(area|census|county|borough|municipality|municipio)\b"
    inner = f"replace(lower(regexp_replace({x}, {q(pat)}, '', 'g')), ' ', '')"
    return f"nullif({collapse(inner)}, '')"


def loc_state(x: str) -> str:
    part = f"(string_split(lower({x}), ','))[2]"
    return f"nullif({collapse(f'replace({part}, {q(chr(32))}, {q(str())})')}, '')"


def loc_county(x: str) -> str:
    return place(f"(string_split(lower({x}), ','))[1]")


def trim_word(x: str) -> str:
    k = tx.WORD_EDGE_KEEP
    return f"regexp_replace(regexp_replace({x}, {q('^[^' + k + ']+')}, ''), {q('[^' + k + ']+$')}, '')"


def strip_special(x: str) -> str:
    a = f"regexp_replace({x}, {q('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + tx.WS_CLASS + ']')}, '', 'g')"
    b = f"regexp_replace({a}, {q(tx.WS_RUN)}, ' ', 'g')"
    return f"trim({b}, ' ')"


def sentences(x: str) -> str:
    marked = f"regexp_replace({x}, {q('([.!?])' + tx.WS_RUN)}, '\\1' || chr(1), 'g')"
    return f"string_split({marked}, chr(1))"


def rnd(x: str) -> str:
    return f"round({x}, 6)"


# --------------------------------------------------------- stand-in CTEs
LEVEL_COLS = ("education_level_1", "education_level_2", "education_level_3", "education_level_4")


def cte_posts() -> str:
    return f"""
lines AS (
  SELECT d.doc_id, d.lang, d.source, p.url,
         unnest(string_split(d.text, chr(10))) AS line,
         unnest(range(len(string_split(d.text, chr(10))))) AS line_no
  FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id),
posts AS (
  SELECT doc_id AS user_id, CAST(line_no AS BIGINT) AS line_no, source AS fip, lang,
         concat_ws(' ', line, CASE WHEN doc_id % 7 = 0 THEN {q(S.EMOJI_MARK)} END,
                   CASE WHEN doc_id % 11 = 0 THEN '★' END, CASE WHEN line_no = 0 THEN url END) AS text
  FROM lines)"""


def cte_levels() -> str:
    cols = ", ".join(f"count_if(lang = {q(lang)}) * {dbl(100)} / count(*) AS {c}"
                     for lang, c in zip(S.LEVEL_LANGS, LEVEL_COLS))
    ys = ", ".join(f"{c} / {dbl(100)} AS y{i}" for i, c in enumerate(LEVEL_COLS))
    return f"""
levels AS (SELECT source AS fip, {cols} FROM documents GROUP BY source),
targets AS (SELECT fip, {ys} FROM levels)"""


def cte_persons(src: str = "posts", name: str = "persons", key: str = "fip", levels: str = "levels",
                keep: str = "line_no") -> str:
    lt = tokens("lower(text)")
    return f"""
{name}_s AS (SELECT {key} AS fip, user_id, {keep}, {strip_stop('text')} AS text FROM {src}),
{name}_t AS (SELECT *, {lt} AS lt FROM {name}_s),
{name} AS (
  SELECT t.fip, t.user_id, t.text,
         array_to_string(list_filter(lt, lambda tk: NOT {is_url('tk')} AND NOT {is_emoji('tk')}), ' ') AS filtered_text,
         len(list_filter(lt, lambda tk: {is_url('tk')})) AS url_count,
         len(list_filter(lt, lambda tk: NOT {is_url('tk')} AND {is_emoji('tk')})) AS emoji_count,
         t.{keep}, {", ".join('l.' + c for c in LEVEL_COLS)}
  FROM {name}_t t JOIN {levels} l ON l.fip = t.fip)"""


def cte_shares(src: str, key: str, name: str) -> str:
    return f"""
{name}_c AS (SELECT {key}, word, count(*) AS cnt
             FROM (SELECT {key}, unnest({tokens('filtered_text')}) AS word FROM {src}) GROUP BY {key}, word),
{name} AS (SELECT {key}, word, cnt, cnt / sum(cnt) OVER (PARTITION BY {key}) AS share FROM {name}_c)"""


def cte_split(src: str = "persons", name: str = "labelled") -> str:
    h = "('0x' || substr(md5(concat_ws(':', '', CAST(user_id AS VARCHAR), CAST(line_no AS VARCHAR))), 1, 8))"
    return f"""
{name} AS (SELECT *, CAST(CAST({h} AS UBIGINT) AS DOUBLE) / {dbl(4294967296.0)} < {dbl(J.TRAIN_FRACTION)} AS is_train
           FROM {src})"""


def p_value(r: str = "slope", n: str = "count") -> str:
    """R3 twin, same Horner order as the Spark expression."""
    a = f"least(abs({r}), {dbl(1.0)})"
    c2 = f"({dbl(1.0)} - {a} * {a})"
    nu = f"({n} - 2)"
    up_e = f"(CAST(floor({nu} / 2) AS INTEGER) - 1)"
    up_o = f"CAST(floor(({nu} - 3) / 2) AS INTEGER)"
    s_e = (f"(CASE WHEN {up_e} >= 1 THEN list_reduce(range({up_e}, 0, -1), lambda acc, kk: "
           f"{dbl(1.0)} + (({c2} * (2 * kk - 1)) / (2 * kk)) * acc, {dbl(1.0)}) ELSE {dbl(1.0)} END)")
    s_o = (f"(CASE WHEN {up_o} >= 1 THEN list_reduce(range({up_o}, 0, -1), lambda acc, kk: "
           f"{dbl(1.0)} + (({c2} * (2 * kk)) / (2 * kk + 1)) * acc, {dbl(1.0)}) ELSE {dbl(1.0)} END)")
    two_pi = f"({dbl(2.0)} / pi())"
    p_e = f"({dbl(1.0)} - {a} * {s_e})"
    p_o = (f"(CASE WHEN {nu} = 1 THEN {dbl(1.0)} - {two_pi} * asin({a}) "
           f"ELSE {dbl(1.0)} - {two_pi} * (asin({a}) + ({a} * sqrt({c2})) * {s_o}) END)")
    p = f"(CASE WHEN {nu} % 2 = 0 THEN {p_e} ELSE {p_o} END)"
    return f"(CASE WHEN {r} IS NULL OR {nu} < 1 THEN NULL ELSE least(greatest({p}, {dbl(0.0)}), {dbl(1.0)}) END)"


def cte_model(obs: str, name: str, min_n: int = J.WORD_COUNT_THRESHOLD, bonferroni: bool = False,
              gate: bool = False) -> str:
    aggs = ["count(*) AS n", "stddev_pop(x) AS sx", "min(x) AS minx", "max(x) AS maxx"]
    for k in range(4):
        aggs += [f"covar_pop(x, y{k}) AS c{k}", f"stddev_pop(y{k}) AS s{k}", f"min(y{k}) AS lo{k}", f"max(y{k}) AS hi{k}"]
    lv = " UNION ALL ".join(
        f"SELECT word, n AS count, {k} AS level, CASE WHEN minx < maxx AND lo{k} < hi{k} "
        f"THEN c{k} / nullif(sx * s{k}, 0) END AS slope FROM {name}_pw" for k in range(4))
    pval = p_value("slope", "count")
    if bonferroni:
        pval = f"{pval} * (SELECT count(*) FROM {name}_pw)"
    slope = "slope"
    if gate:
        slope = (f"CASE WHEN slope IS NULL OR pv > {dbl(J.ALPHA)} OR slope < {dbl(J.POSITIVE_IMPORTANCY)} "
                 f"THEN {dbl(0.0)} ELSE slope END")
    return f"""
{name}_pw AS (SELECT word, {", ".join(aggs)} FROM {obs} GROUP BY word HAVING count(*) > {min_n}),
{name}_lv AS ({lv}),
{name}_pv AS (SELECT word, level, slope, {pval} AS pv, count FROM {name}_lv),
{name} AS (SELECT word, level, {slope} AS slope, pv AS pval, count FROM {name}_pv)"""


def cte_obs(shares: str, name: str, trim: bool) -> str:
    stop = f"NOT list_contains({str_list(S.STOP_WORDS)}, replace(word, '’', ''''))"
    ys = ", ".join(f"t.y{k}" for k in range(4))
    if trim:
        return f"""
{name}_0 AS (SELECT fip, {trim_word('word')} AS word, share AS x FROM {shares} WHERE {stop}),
{name} AS (SELECT o.fip, o.word, o.x, {ys} FROM {name}_0 o JOIN targets t ON t.fip = o.fip
           WHERE o.word <> '' AND o.word <> 'NaN')"""
    return f"""
{name} AS (SELECT o.fip, o.word, o.share AS x, {ys} FROM {shares} o JOIN targets t ON t.fip = o.fip WHERE {stop})"""


def cte_wide(model: str, name: str) -> str:
    cols = []
    for k in range(4):
        cols += [f"coalesce(max(CASE WHEN level = {k} THEN slope END), {dbl(0.0)}) AS slope_{k}",
                 f"coalesce(max(CASE WHEN level = {k} THEN pval END), {dbl(0.0)}) AS pval_{k}",
                 f"CAST(coalesce(max(CASE WHEN level = {k} THEN count END), 0) AS BIGINT) AS count_{k}"]
    return f"\n{name} AS (SELECT word, {', '.join(cols)} FROM {model} GROUP BY word)"


def cte_classify(persons: str, model: str, name: str) -> str:
    scores = ", ".join(f"sum(u.cnt * coalesce(w.slope_{k}, {dbl(0.0)})) / sum(u.cnt) AS score_{k}" for k in range(4))
    sc = [f"coalesce(s.score_{k}, {dbl(0.0)})" for k in range(4)]
    arr = "[" + ", ".join(sc) + "]"
    return f"""
{cte_shares(persons, 'user_id', name + '_uw').strip()},
{name}_u AS (SELECT user_id, arg_max(fip, line_no) AS fip FROM {persons} GROUP BY user_id),
{cte_wide(model, name + '_w').strip()},
{name}_s AS (SELECT u.user_id, {scores} FROM {name}_uw u LEFT JOIN {name}_w w ON w.word = u.word GROUP BY u.user_id),
{name} AS (
  SELECT u.user_id, u.fip, {", ".join(f'{c} AS score_{k}' for k, c in enumerate(sc))},
         CAST(list_position({arr}, list_max({arr})) - 1 AS BIGINT) AS predicted_level
  FROM {name}_u u SEMI JOIN {name}_uw x ON x.user_id = u.user_id
  LEFT JOIN {name}_s s ON s.user_id = u.user_id)"""


def cte_evaluate(pred: str, name: str) -> str:
    dist = ", ".join(f"count_if(predicted_level = {k}) / count(*) AS pred_{k}" for k in range(4))
    err = " + ".join(f"abs(d.pred_{k} - t.y{k})" for k in range(4))
    return f"""
{name}_d AS (SELECT fip, {dist}, count(*) AS n_users FROM {pred} GROUP BY fip),
{name} AS (SELECT d.fip, d.n_users, {", ".join(f't.y{k}' for k in range(4))}, {", ".join(f'd.pred_{k}' for k in range(4))},
                  ({err}) / {dbl(4.0)} AS error
           FROM {name}_d d JOIN targets t ON t.fip = d.fip)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes) + "\n"


BASE = (cte_posts(), cte_levels(), cte_persons())


def x2_ctes() -> tuple[str, ...]:
    return BASE + (
        cte_split(),
        "\ntrain AS (SELECT * FROM labelled WHERE is_train)",
        "\ntest AS (SELECT * FROM labelled WHERE NOT is_train)",
        cte_shares("train", "fip", "trw"),
        cte_obs("trw", "obs2", trim=False),
        cte_model("obs2", "m2", bonferroni=True, gate=True),
        cte_classify("test", "m2", "pred"),
        cte_evaluate("pred", "ev"),
    )


def x3_ctes() -> tuple[str, ...]:
    return BASE + (cte_shares("persons", "fip", "rw"), cte_obs("rw", "obs3", trim=True), cte_model("obs3", "m3"))


MODEL_OUT = "SELECT word, CAST(level AS BIGINT) AS level, round(slope, 6) AS slope, round(pval, 6) AS pval, CAST(count AS BIGINT) AS count FROM {m}"


def top_sql(ascending: bool) -> str:
    order = "slope ASC" if ascending else "slope DESC"
    return with_(*x3_ctes()) + f"""
SELECT word, CAST(level AS BIGINT) AS level, round(slope, 6) AS slope, round(pval, 6) AS pval,
       CAST(count AS BIGINT) AS count, CAST(rank AS BIGINT) AS rank
FROM (SELECT *, row_number() OVER (ORDER BY {order}, word ASC) AS rank FROM m3
      WHERE level = {J.REPORT_LEVEL} AND count > {J.REPORT_MIN_N} AND pval < {dbl(J.REPORT_MAX_P)})
WHERE rank <= {J.TOP_N}"""


# ------------------------------------------------------ places stand-ins
def region_code(x: str) -> str:
    return f"upper(substr(replace({x}, ' ', ''), 1, 2))"


def lat_of(k: str) -> str:
    return f"({dbl(25.0)} + (({k} * 7919) % 2500) / {dbl(100.0)})"


def lon_of(k: str) -> str:
    return f"({dbl(-125.0)} + (({k} * 104729) % 5800) / {dbl(100.0)})"


def cte_attainment() -> str:
    pct = ", ".join(f"count_if(c_mktsegment = {q(s)}) * {dbl(100)} / count(*) AS p{i}" for i, s in enumerate(S.SEGMENTS))
    vals = []
    for c in ATTAINMENT_VALUE_COLUMNS:
        year, k = c.split("-")
        vals.append(f"CASE WHEN (fips + {int(year)}) % 5 = 0 THEN '' ELSE coalesce(CAST(p{k} AS VARCHAR), '') END AS \"{c}\"")
    return f"""
cust_n AS (SELECT c.c_nationkey, c.c_mktsegment, n.n_regionkey FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey),
by_nation AS (SELECT c_nationkey, {pct} FROM cust_n GROUP BY c_nationkey),
by_region AS (SELECT n_regionkey, {pct} FROM cust_n GROUP BY n_regionkey),
att_rows AS (
  SELECT (n.n_regionkey + 1) * 1000 + n.n_nationkey + 1 AS fips, {region_code('r.r_name')} AS State,
         n.n_name || ' County' AS Area, b.p0, b.p1, b.p2, b.p3
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN by_nation b ON n.n_nationkey = b.c_nationkey
  UNION ALL
  SELECT (r.r_regionkey + 1) * 1000, {region_code('r.r_name')}, r.r_name, b.p0, b.p1, b.p2, b.p3
  FROM region r LEFT JOIN by_region b ON r.r_regionkey = b.n_regionkey),
att_raw AS (SELECT CAST(fips AS VARCHAR) AS FIPS, State, Area, {", ".join(vals)} FROM att_rows),
att_clean AS (
  SELECT TRY_CAST(trim(FIPS) AS BIGINT) AS FIPS, lower(State) AS State, {place('Area')} AS Area,
         {", ".join(f'coalesce(TRY_CAST(trim("{c}") AS DOUBLE), {dbl(0.0)}) AS "{c}"' for c in ATTAINMENT_VALUE_COLUMNS)}
  FROM att_raw),
att_levels AS (SELECT FIPS AS fips, {", ".join(f'"{c}" AS {n}' for c, n in zip(ATTAINMENT_VALUE_COLUMNS[-4:], LEVEL_COLS))}
               FROM att_clean),
names AS (
  SELECT name, arg_max(fips, fips * 2 + kind) AS fips FROM (
    SELECT {place('Area')} AS name, TRY_CAST(trim(FIPS) AS BIGINT) AS fips, 0 AS kind FROM att_raw
    UNION ALL
    SELECT lower(State), TRY_CAST(trim(FIPS) AS BIGINT), 1 FROM att_raw WHERE TRY_CAST(trim(FIPS) AS BIGINT) % 1000 = 0)
  WHERE name IS NOT NULL AND fips IS NOT NULL GROUP BY name)"""


def cte_zips() -> str:
    f = "(n.n_regionkey + 1) * 1000 + n.n_nationkey + 1"
    return f"""
zc AS (
  SELECT CAST(c.c_custkey AS VARCHAR) AS zip, printf('%05d', {f}) AS fips
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  UNION ALL
  SELECT CAST(c.c_custkey AS VARCHAR), printf('%05d', {f})
  FROM customer c JOIN nation n ON n.n_nationkey = (c.c_nationkey + 1) % (SELECT count(*) FROM nation)
  WHERE c.c_custkey % 10 = 0),
zc_t AS (SELECT trim(zip) AS zip, TRY_CAST(trim(fips) AS BIGINT) AS fips FROM zc),
zips_one AS (SELECT zip, max(fips) AS fips FROM zc_t WHERE zip IS NOT NULL AND fips IS NOT NULL GROUP BY zip),
zips_all AS (SELECT DISTINCT zip, fips FROM zc_t WHERE zip IS NOT NULL AND fips IS NOT NULL),
cents AS (SELECT c_custkey AS zip, {lat_of('c_custkey')} AS lat, {lon_of('c_custkey')} AS lon FROM customer)"""


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    rad = dbl(math.pi / 180.0)
    s1 = f"sin((({lat2}) - ({lat1})) * {rad} / 2)"
    s2 = f"sin((({lon2}) - ({lon1})) * {rad} / 2)"
    a = f"({s1} * {s1} + cos(({lat1}) * {rad}) * cos(({lat2}) * {rad}) * ({s2} * {s2}))"
    return f"({dbl(2 * EARTH_RADIUS_MILES)} * asin(sqrt(least({a}, {dbl(1.0)}))))"


def cte_nearest(points: str, cents: str, name: str, zip_expr: str = "c.zip") -> str:
    d = hav("p.lat", "p.lon", "c.lat", "c.lon")
    return f"""
{name}_p AS (SELECT p.point_id, {zip_expr} AS zip, {d} AS dist FROM {points} p, {cents} c WHERE {d} <= {dbl(J.RADIUS_MILES)}),
{name} AS (SELECT point_id, zip, dist FROM (
            SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY dist, zip) AS rn FROM {name}_p) WHERE rn = 1)"""


_LOC = (f"CASE kind WHEN 0 THEN n_name || ', ' || r_name "
        f"WHEN 1 THEN n_name || repeat(right(n_name, 1), 3) || ' County' "
        f"WHEN 2 THEN 'Somewhere, ' || r_name WHEN 4 THEN 'Nowhere, Atlantis' "
        f"WHEN 5 THEN n_name || ', ' || {region_code('r_name')} END")


def cte_located() -> str:
    nm = "n.n_name"
    loc = _LOC
    coords = f"CASE WHEN kind = 3 THEN [{lat_of('user_id')} + {dbl(0.02)}, {lon_of('user_id')} + {dbl(0.02)}] END"
    return f"""
jp AS (SELECT p.user_id, p.line_no, p.lang, p.text, {nm} AS n_name, r.r_name, p.user_id % 6 AS kind
       FROM posts p LEFT JOIN nation n ON n.n_nationkey = p.user_id % (SELECT count(*) FROM nation)
       LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
       WHERE (p.user_id * 31 + p.line_no) % 50 <> 0),
jp2 AS (SELECT user_id, line_no, lang, text, {loc} AS location, {coords} AS coords FROM jp),
located AS (
  SELECT CAST(user_id AS VARCHAR) || ':line ' || CAST(line_no AS VARCHAR) AS post_id, user_id, location,
         {loc_state('location')} AS state, {loc_county('location')} AS county, coords, text
  FROM jp2 WHERE user_id IS NOT NULL AND lang = 'en' AND (location IS NOT NULL OR coords IS NOT NULL))"""


def cte_resolved() -> str:
    return cte_posts() + "," + cte_attainment() + "," + cte_zips() + "," + cte_located() + "," + f"""
r0 AS (SELECT l.*, cn.fips AS f_county, sn.fips AS f_state FROM located l
       LEFT JOIN names cn ON cn.name = l.county LEFT JOIN names sn ON sn.name = l.state),
need AS (SELECT post_id AS point_id, coords[1] AS lat, coords[2] AS lon FROM r0
         WHERE f_county IS NULL AND f_state IS NULL AND coords IS NOT NULL
           AND coords[1] IS NOT NULL AND coords[2] IS NOT NULL),
{cte_nearest('need', 'cents', 'nb', 'CAST(c.zip AS VARCHAR)').strip()},
bz AS (SELECT nb.point_id AS post_id, z.fips AS f_coord FROM nb JOIN zips_one z ON z.zip = nb.zip
       WHERE z.fips IN (SELECT fips FROM att_levels)),
resolved AS (
  SELECT r0.post_id, r0.user_id, r0.text, r0.state, r0.county,
         coalesce(f_county, f_state, bz.f_coord) AS fips,
         CASE WHEN f_county IS NOT NULL THEN 'county' WHEN f_state IS NOT NULL THEN 'state'
              WHEN bz.f_coord IS NOT NULL THEN 'coordinates' END AS resolved_by
  FROM r0 LEFT JOIN bz ON bz.post_id = r0.post_id
  WHERE coalesce(f_county, f_state, bz.f_coord) IS NOT NULL)"""


def x1_person_ctes() -> str:
    return "WITH " + cte_resolved().strip("\n") + "," + cte_persons(
        "resolved", "xp", key="fips", levels="att_levels_k", keep="post_id").replace(
        "xp_s AS", "att_levels_k AS (SELECT fips AS fip, * EXCLUDE (fips) FROM att_levels),\nxp_s AS", 1) + "\n"


# ------------------------------------------------------------ the oracle
def _persons_sql() -> str:
    return with_(*BASE)


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}
    lv = ", ".join(f"round({c}, 6) AS {c}" for c in LEVEL_COLS)

    # text scalars -----------------------------------------------------
    o["t1_collapse_tail"] = f"""
SELECT c_custkey, raw, {collapse('raw')} AS collapsed FROM (
  SELECT c_custkey, lower(c_mktsegment) || repeat(lower(right(c_mktsegment, 1)), CAST(c_custkey % 5 AS INTEGER)) AS raw
  FROM customer)"""
    sfx = "CASE " + " ".join(f"WHEN c.c_custkey % {len(_SUFFIXES)} = {i} THEN {q(s)}" for i, s in enumerate(_SUFFIXES)) + " END"
    cust_names = ("customer c JOIN nation n ON c.c_nationkey = n.n_nationkey "
                  "JOIN region r ON n.n_regionkey = r.r_regionkey")
    o["t2_place_name"] = f"""
SELECT c_custkey, raw, {place('raw')} AS place FROM (
  SELECT c.c_custkey, nm || repeat(right(nm, 1), CAST(c.c_custkey % 3 AS INTEGER)) || {sfx} AS raw
  FROM (SELECT *, replace(n_name, '_', ' ') AS nm FROM nation) n
  JOIN customer c ON c.c_nationkey = n.n_nationkey)"""
    o["t3_split_location"] = f"""
SELECT c_custkey, loc, {loc_state('loc')} AS state, {loc_county('loc')} AS county FROM (
  SELECT c.c_custkey,
         CASE WHEN c.c_custkey % 4 = 0 THEN n.n_name || {sfx} || ', ' || r.r_name
              WHEN c.c_custkey % 4 = 1 THEN n.n_name || ',  ' || r.r_name || 'AA, USA'
              WHEN c.c_custkey % 4 = 2 THEN n.n_name END AS loc
  FROM {cust_names})"""
    o["t4_tokens"] = f"""
SELECT doc_id, CAST(len({tokens('text')}) AS BIGINT) AS n_tokens,
       CAST(len(list_distinct(list_transform({tokens('text')}, lambda w: lower(w)))) AS BIGINT) AS n_distinct_lower,
       CAST(length(text) AS BIGINT) AS n_chars
FROM documents"""
    o["t5_strip_stop_words"] = _persons_sql() + f"""
SELECT user_id, line_no, {strip_stop('text')} AS text, CAST(length({strip_stop('text')}) AS BIGINT) AS n_chars,
       CAST(length(text) AS BIGINT) AS n_chars_before
FROM posts"""
    o["t9_token_classes"] = _persons_sql() + f"""
SELECT CASE WHEN {is_url('tok')} THEN 'url' WHEN {is_emoji('tok')} THEN 'emoji' ELSE 'word' END AS token_class,
       count(*) AS n
FROM (SELECT unnest({tokens('lower(text)')}) AS tok FROM posts) GROUP BY 1"""
    o["t11_trim_words"] = f"""
SELECT word, count(*) AS n FROM (SELECT {trim_word('tok')} AS word FROM (SELECT unnest({tokens('text')}) AS tok FROM documents))
WHERE word <> '' GROUP BY word"""
    o["t12_strip_special"] = f"""
SELECT doc_id, {strip_special('text')} AS clean, CAST(length({strip_special('text')}) AS BIGINT) AS n_chars FROM documents"""
    sents = f"""
sents AS (SELECT doc_id, unnest({sentences('text')}) AS text, unnest(range(len({sentences('text')}))) AS sent_no FROM documents),
docs AS (SELECT doc_id, CAST(sent_no AS BIGINT) AS sent_no, text FROM sents WHERE len({tokens('text')}) > 0)"""
    wt = "regexp_replace(regexp_replace(lower({x}), '^[^\\p{{L}}\\p{{N}}]+', ''), '[.!?]+$', '')"
    mk = "CASE WHEN right({x}, 1) IN ('.', '!', '?') THEN right({x}, 1) ELSE '' END"
    ll = ("(CASE WHEN {k} = 0 THEN 0 ELSE {k} * ln({p}) END + CASE WHEN {n} - {k} = 0 THEN 0 ELSE ({n} - {k}) * ln(1 - {p}) END)")
    model = with_(f"""
tk AS (SELECT {tokens('text')} AS t FROM documents),
tp AS (SELECT unnest(t) AS t, unnest(list_append(t[2:], NULL)) AS n FROM tk),
tw AS (SELECT {wt.format(x='t')} AS word, {mk.format(x='t')} AS mark, {wt.format(x='n')} AS next FROM tp),
ec AS (SELECT word, mark, CASE WHEN mark <> '' THEN next END AS next FROM tw WHERE word <> ''),
tot AS (SELECT count(*) AS n_all, count_if(mark = '.') AS k_all FROM ec),
wd AS (SELECT word, count(*) AS n, count_if(mark = '.') AS k, length(replace(word, '.', '')) AS size FROM ec GROUP BY word),
ab AS (
  SELECT word, k AS n_period, n - k AS n_plain,
         -2 * ({ll.format(k='k', n='n', p='(k_all / n_all)')} - {ll.format(k='k', n='n', p=dbl(0.99))})
           * exp(-CAST(size AS DOUBLE)) * (length(word) - size + 1) * pow(CAST(size AS DOUBLE), -CAST(n - k AS DOUBLE)) AS score
  FROM wd, tot WHERE k > 0 AND k_all < n_all AND regexp_matches(word, '^\\p{{L}}+(\\.\\p{{L}}+)*$')),
abbr AS (SELECT * FROM ab WHERE score >= {dbl(0.3)}),
ends AS (SELECT next AS word, count(*) AS a FROM ec WHERE next <> ''
           AND (mark IN ('!', '?') OR (mark = '.' AND word NOT IN (SELECT word FROM abbr))) GROUP BY next),
nb AS (SELECT sum(a)::BIGINT AS b FROM ends),
st AS (
  SELECT ends.word, a AS n_start, n AS n_total,
         -2 * ({ll.format(k='a', n='b', p='(n / n_all)')} + {ll.format(k='(n - a)', n='(n_all - b)', p='(n / n_all)')}
               - {ll.format(k='a', n='b', p='(a / b)')} - {ll.format(k='(n - a)', n='(n_all - b)', p='((n - a) / (n_all - b))')}) AS score
  FROM ends JOIN wd ON wd.word = ends.word, tot, nb
  WHERE n_all > b AND n < n_all AND a / b > n / n_all AND regexp_matches(ends.word, '^\\p{{L}}')),
starters AS (SELECT * FROM st WHERE score >= {dbl(30.0)})""")
    o["t14_abbreviations"] = model + "SELECT word, n_period, n_plain, round(score, 6) AS score FROM abbr"
    o["t14_sentence_starters"] = model + "SELECT word, n_start, n_total, round(score, 6) AS score FROM starters"
    o["t14_learned_sentences"] = model + f""", fr AS (
  SELECT k, doc_id, unnest({sentences('text')}) AS text, unnest(range(len({sentences('text')}))) AS sent_no
  FROM (SELECT row_number() OVER () AS k, doc_id, text FROM documents)),
ft AS (SELECT *, {tokens('text')} AS t FROM fr WHERE len({tokens('text')}) > 0),
fl AS (SELECT *, lag(t[-1]) OVER w AS prev, t[1] AS first FROM ft WINDOW w AS (PARTITION BY k ORDER BY sent_no)),
fj AS (SELECT *, prev IS NOT NULL AND right(prev, 1) = '.' AND {wt.format(x='prev')} IN (SELECT word FROM abbr)
              AND NOT (regexp_matches(first, '^[^\\p{{L}}\\p{{N}}]*\\p{{Lu}}')
                       AND {wt.format(x='first')} IN (SELECT word FROM starters)) AS joins FROM fl),
fg AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY sent_no) AS run FROM fj)
SELECT doc_id, min(sent_no) AS sent_no, string_agg(text, ' ' ORDER BY sent_no) AS text FROM fg GROUP BY k, doc_id, run"""
    o["t14_sentences"] = with_(sents) + f"""
SELECT doc_id, sent_no, text, CAST(len({tokens('text')}) AS BIGINT) AS n_tokens FROM docs"""
    o["t15_parse_vector"] = f"""
SELECT vec_id, CAST(pos - 1 AS BIGINT) AS pos, round(value, 6) AS value FROM (
  SELECT vec_id, unnest(v) AS value, unnest(range(1, len(v) + 1)) AS pos FROM (
    SELECT vec_id, list_transform({tokens("regexp_replace('[' || array_to_string(list_transform(embedding, lambda e: CAST(CAST(e AS DOUBLE) AS VARCHAR)), ' ') || ']', '[\\[\\]]', '', 'g')")},
                                  lambda s: TRY_CAST(s AS DOUBLE)) AS v
    FROM embeddings))"""
    o["t16_parse_lat_long"] = f"""
SELECT c_custkey, round(TRY_CAST(trim((string_split(t, ','))[1]) AS DOUBLE), 6) AS lat,
       round(TRY_CAST(trim((string_split(t, ','))[2]) AS DOUBLE), 6) AS long
FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'n/a'
             ELSE CAST({lat_of('c_custkey')} AS VARCHAR) || ', ' || CAST({lon_of('c_custkey')} AS VARCHAR) END AS t
      FROM customer)"""

    # sources / decode ---------------------------------------------------
    o["s3_decode_events"] = "SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"
    o["s1_read_posts"] = "WITH " + (cte_posts() + "," + cte_located()).strip("\n") + """
SELECT user_id, lang, location, 'line ' || CAST(line_no AS VARCHAR) AS created_at, text FROM jp2"""
    o["s3_corrupt_lines"] = with_(cte_posts()) + """
SELECT count_if((user_id * 31 + line_no) % 50 = 0) AS n_corrupt, count(DISTINCT user_id) AS n_notices FROM posts"""
    o["s4_zip_county_csv"] = "WITH " + cte_zips().strip("\n") + "\nSELECT zip, fips FROM zc"
    o["s6_stop_word_file"] = with_(cte_posts()) + f"""
SELECT word, count(*) AS n FROM (SELECT unnest({tokens('lower(text)')}) AS word FROM posts)
WHERE NOT list_contains({str_list(S.STOP_WORDS)}, replace(word, '’', {q(chr(39))})) GROUP BY word"""
    o["p2_located_posts"] = "WITH " + (cte_posts() + "," + cte_located()).strip("\n") + """
SELECT post_id, user_id, location, state, county, round(coords[1], 6) AS lat, round(coords[2], 6) AS lon FROM located"""

    o["p3_strict_located"] = with_(cte_posts()) + f"""
, jp AS (SELECT p.user_id, p.line_no, p.lang, n.n_name, r.r_name, p.user_id % 6 AS kind
       FROM posts p LEFT JOIN nation n ON n.n_nationkey = p.user_id % (SELECT count(*) FROM nation)
       LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
       WHERE (p.user_id * 31 + p.line_no) % 50 <> 0),
jp2 AS (SELECT user_id, line_no, lang, {_LOC} AS location FROM jp)
SELECT CAST(user_id AS VARCHAR) || ':line ' || CAST(line_no AS VARCHAR) AS post_id, user_id, location
FROM jp2 WHERE user_id IS NOT NULL AND user_id <> 0 AND location IS NOT NULL AND location <> '' AND lang = 'en'"""

    # places ---------------------------------------------------------------
    att = "WITH " + cte_attainment().strip("\n") + "\n"
    o["p8_clean_attainment"] = att + "SELECT FIPS, State, Area, " + ", ".join(
        f'round("{c}", 6) AS "{c}"' for c in ATTAINMENT_VALUE_COLUMNS) + " FROM att_clean WHERE FIPS % 1000 <> 0"
    o["s5_attainment_csv"] = o["p8_clean_attainment"]
    o["x6_attainment_counts"] = att + "SELECT count(*) AS n_total, count_if(FIPS % 1000 <> 0) AS n_valid FROM att_clean"
    last = ATTAINMENT_VALUE_COLUMNS[-4:]
    ranked = " UNION ALL ".join(f'SELECT *, {i} AS level, "{c}" AS pct FROM att_clean WHERE FIPS % 1000 <> 0'
                                for i, c in enumerate(last))
    o["w1_attainment_top"] = att + "SELECT FIPS, State, Area, " + ", ".join(f'round("{c}", 6) AS "{c}"' for c in last) + f""",
       CAST(level AS BIGINT) AS level, round(pct, 6) AS pct, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY level ORDER BY pct DESC, FIPS ASC) AS rank FROM ({ranked}))
WHERE rank <= 10"""
    o["j9_place_names"] = att + "SELECT name, fips FROM names"
    zips = "WITH " + cte_zips().strip("\n") + "\n"
    o["j10_zip_table"] = zips + "SELECT zip, fips FROM zips_one"
    pts = (f"pts AS (SELECT s_suppkey AS point_id, {lat_of('s_suppkey')} + {dbl(0.05)} AS lat, "
           f"{lon_of('s_suppkey')} - {dbl(0.05)} AS lon FROM supplier)")
    near = "WITH " + cte_zips().strip("\n") + ",\n" + pts + "," + cte_nearest("pts", "cents", "near") + "\n"
    o["j3_nearest_zip"] = near + "SELECT point_id, zip, round(dist, 6) AS dist FROM near"
    o["j3_three_nearest_zips"] = near + """, three AS (
SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY dist, zip) AS rank FROM near_p)
SELECT point_id, rank, zip, round(dist, 6) AS dist FROM three WHERE rank <= 3"""
    o["j6_points_to_counties"] = near + """
SELECT z.zip, n.point_id, round(n.dist, 6) AS dist, z.fips FROM near n JOIN zips_all z ON z.zip = CAST(n.zip AS VARCHAR)"""
    x5 = with_(cte_posts(), cte_zips(), f"""
stated AS (SELECT *, {lat_of('user_id')} + {dbl(0.02)} AS lat, {lon_of('user_id')} + {dbl(0.02)} AS lon FROM posts
           WHERE (user_id * 31 + line_no) % 50 <> 0 AND user_id % 6 = 3 AND user_id <> 0 AND lang = 'en'),
spts AS (SELECT DISTINCT user_id AS point_id, lat, lon FROM stated)""", cte_nearest("spts", "cents", "snear"), """
counties AS (SELECT z.fips, s.user_id, s.text, 'line ' || CAST(s.line_no AS VARCHAR) AS created_at
             FROM stated s JOIN snear n ON n.point_id = s.user_id JOIN zips_all z ON z.zip = CAST(n.zip AS VARCHAR))""")
    o["x5_located_counties"] = x5 + "SELECT fips, user_id, text, created_at FROM counties"
    o["x5_located_counts"] = x5 + """SELECT count(*) AS n_total,
       (SELECT count(*) FROM counties) AS n_valid FROM posts"""
    bad = "(user_id * 31 + line_no) % 50 = 0"
    o["a9_ingest_counts"] = with_(cte_posts()) + f"""
SELECT count(*) AS n_total, count_if({bad}) AS n_corrupt, 0::BIGINT AS n_notice,
       count_if(NOT {bad} AND NOT (lang = 'en' AND user_id <> 0)) AS n_dropped,
       count_if(NOT {bad} AND lang = 'en' AND user_id <> 0) AS n_valid FROM posts"""
    o["s3_quarantined_lines"] = with_(cte_posts()) + f"""
SELECT user_id, line_no, '{{bad json' AS value FROM posts WHERE {bad}"""
    o["j5_resolve_places"] = "WITH " + cte_resolved().strip("\n") + "\nSELECT post_id, state, county, fips, resolved_by FROM resolved"
    o["x1_person_records"] = x1_person_ctes() + f"""
SELECT post_id, fip, user_id, text, filtered_text, url_count, emoji_count, {lv} FROM xp"""
    o["x1_county_records"] = x1_person_ctes() + f"""
SELECT fip, count(*) AS tweet_count, CAST(sum(url_count) AS BIGINT) AS url_count,
       CAST(sum(emoji_count) AS BIGINT) AS emoji_count, {", ".join(f'round(max({c}), 6) AS {c}' for c in LEVEL_COLS)}
FROM xp GROUP BY fip"""

    o["j4_unmatched_zips"] = "WITH " + cte_resolved().strip("\n") + """
SELECT count(*) AS n_posts, count(DISTINCT nb.zip) AS n_zips FROM nb LEFT JOIN zips_one z ON z.zip = nb.zip
WHERE z.fips IS NULL OR z.fips NOT IN (SELECT fips FROM att_levels)"""
    o["x1_county_words"] = x1_person_ctes().rstrip("\n") + "," + cte_shares("xp", "fip", "xw") + """
SELECT fip, word, cnt, round(share, 6) AS share FROM xw"""
    o["x1_person_tsv"] = o["x1_person_records"]
    o["s10_county_records_tsv"] = o["x1_county_records"]

    # profiles ---------------------------------------------------------------
    o["a4_person_records"] = _persons_sql() + f"""
SELECT fip, user_id, text, filtered_text, url_count, emoji_count, line_no, {lv} FROM persons"""
    o["s3_person_lines"] = o["a4_person_records"]
    o["a1_archived_totals"] = _persons_sql() + """
SELECT fip, count(*) AS tweet_count, CAST(sum(url_count) AS BIGINT) AS url_count,
       CAST(sum(emoji_count) AS BIGINT) AS emoji_count FROM persons GROUP BY fip"""
    o["a1_region_words"] = with_(*BASE, cte_shares("persons", "fip", "rw")) + "SELECT fip, word, cnt, round(share, 6) AS share FROM rw"
    o["a1_region_totals"] = _persons_sql() + f"""
SELECT fip, count(*) AS tweet_count, CAST(sum(url_count) AS BIGINT) AS url_count,
       CAST(sum(emoji_count) AS BIGINT) AS emoji_count, {", ".join(f'round(max({c}), 6) AS {c}' for c in LEVEL_COLS)}
FROM persons GROUP BY fip"""
    o["a2_region_word_share"] = o["a1_region_words"]
    o["a2_region_profile"] = _persons_sql() + f"""
SELECT fip, count(*) AS tweet_count, round(avg(url_count), 6) AS avg_url_count, round(avg(emoji_count), 6) AS avg_emoji_count,
       {", ".join(f'round(arg_max({c}, line_no), 6) AS {c}' for c in LEVEL_COLS)}
FROM persons GROUP BY fip"""
    o["a2_archived_word_share"] = o["a2_region_word_share"]
    o["a3_user_word_share"] = with_(*BASE, cte_shares("persons", "user_id", "uw")) + \
        "SELECT user_id, word, cnt, round(share, 6) AS share FROM uw"
    o["a3_user_profile"] = _persons_sql() + f"""
SELECT user_id, count(*) AS tweet_count, round(avg(url_count), 6) AS avg_url_count, round(avg(emoji_count), 6) AS avg_emoji_count,
       {", ".join(f'round(arg_max({c}, line_no), 6) AS {c}' for c in LEVEL_COLS)}, arg_max(fip, line_no) AS fip
FROM persons GROUP BY user_id"""

    o["s9_region_profile_json"] = o["a2_region_profile"]

    # word model ---------------------------------------------------------
    x2 = with_(*x2_ctes())
    o["a5_word_observations"] = x2 + f"SELECT word, count(*) AS n FROM obs2 GROUP BY word HAVING count(*) > {J.WORD_COUNT_THRESHOLD}"
    o["a6_bonferroni_factor"] = x2 + "SELECT count(*) AS m FROM m2_pw"
    o["r1_word_regression"] = with_(*x3_ctes()) + MODEL_OUT.format(m="m3")
    # the hypergeometric series in 1 - r^2, summed term by term with the library's log gamma
    o["r3_tail_p_values"] = f"""
WITH t AS (SELECT p_partkey, (100 + p_partkey * 7919 % 891) / {dbl(1000)} AS r, 3 + p_partkey * 104729 % 301 AS n
           FROM part),
u AS (SELECT *, (n - 2) / {dbl(2)} AS a, ln(1 - r * r) AS lx FROM t)
SELECT p_partkey, n, round(r, 6) AS r,
       round((a * lx + ln(r) + lgamma(a + 0.5) - lgamma(a) - lgamma(0.5) - ln(a)
              + ln(list_sum(list_transform(range(0, 2500), lambda k:
                  exp(lgamma(a + 0.5 + k) - lgamma(a + 0.5) - lgamma(a + 1 + k) + lgamma(a + 1) + k * lx))))) / ln(10), 6)
         AS log10_p
FROM u"""
    o["r6_word_model"] = x2 + MODEL_OUT.format(m="m2").replace("round(pval, 6)", "round(pval, 3)")
    o["a12_model_wide"] = x2 + "SELECT word, " + ", ".join(
        f"round(slope_{k}, 6) AS slope_{k}, round(pval_{k}, 3) AS pval_{k}, count_{k}" for k in range(4)) + " FROM pred_w"
    o["s7_s11_word_model_csv"] = o["r1_word_regression"]
    o["w4_top_words"] = top_sql(False)
    o["w5_bottom_words"] = top_sql(True)

    # split / predict / evaluate -----------------------------------------
    o["r7_train_test_split"] = with_(*BASE, cte_split()) + "SELECT user_id, line_no, fip, is_train FROM labelled"
    h = "CAST(CAST(('0x' || substr(md5(concat_ws(':', '', CAST(user_id AS VARCHAR), CAST(line_no AS VARCHAR))), 1, 8)) AS UBIGINT) AS DOUBLE) / " + dbl(4294967296.0)
    o["r8_three_way_split"] = with_(cte_posts()) + f"""
SELECT user_id, line_no, CAST(CASE WHEN u < {dbl(0.7)} THEN 0 WHEN u < {dbl(0.9)} THEN 1 ELSE 2 END AS BIGINT) AS split_label
FROM (SELECT user_id, line_no, {h} AS u FROM posts)"""
    o["a9_split_counts"] = with_(*BASE, cte_split()) + \
        "SELECT count(*) AS total, count_if(is_train) AS train, count_if(NOT is_train) AS test FROM labelled"
    o["r9_classify_users"] = x2 + "SELECT user_id, fip, " + ", ".join(
        f"round(score_{k}, 6) AS score_{k}" for k in range(4)) + ", predicted_level FROM pred"
    ev_out = ("SELECT fip, n_users, " + ", ".join(f"round(y{k}, 6) AS y{k}" for k in range(4)) + ", "
              + ", ".join(f"round(pred_{k}, 6) AS pred_{k}" for k in range(4)) + ", round(error, 6) AS error FROM ev")
    o["r10_evaluate"] = x2 + ev_out
    o["a10_mean_error"] = x2 + "SELECT round(avg(error), 6) AS mean_error, count(*) AS n_regions FROM ev"
    o["x4_score_saved_model"] = with_(*x3_ctes(), cte_classify("persons", "m3", "pa"), cte_evaluate("pa", "eva")) + \
        "SELECT round(avg(error), 6) AS mean_error, count(*) AS n_regions FROM eva"

    o["x4_score_bucketed_tables"] = o["x4_score_saved_model"]

    # usage by group: the lower incomplete gamma function as a sum of positive terms
    ks = range(4)
    over = ", ".join(f"CASE WHEN t{k} > 0 THEN round(n_{k} / (w * t{k} / t), 9) ELSE 0 END" for k in ks)
    g = " + ".join(f"CASE WHEN n_{k} > 0 THEN n_{k} * ln(n_{k} / (w * t{k} / t)) ELSE 0 END"
                   f" + CASE WHEN t{k} > n_{k} THEN (t{k} - n_{k}) * ln((t{k} - n_{k}) / (t{k} - w * t{k} / t)) ELSE 0 END"
                   for k in ks)
    o["x3_word_usage_by_level"] = with_(*BASE, cte_shares("persons", "fip", "rw"), f"""
dev AS (SELECT fip, [{", ".join(f"round(y{k} - (SELECT avg(y{k}) FROM targets), 9)" for k in ks)}] AS a FROM targets),
grp AS (SELECT fip, list_position(a, list_max(a)) - 1 AS level FROM dev),
lw AS (SELECT word, level, cnt FROM rw_c JOIN grp USING (fip)),
tot AS (SELECT {", ".join(f"CAST(sum(CASE WHEN level = {k} THEN cnt ELSE 0 END) AS DOUBLE) AS t{k}" for k in ks)} FROM lw),
per AS (SELECT word, {", ".join(f"CAST(sum(CASE WHEN level = {k} THEN cnt ELSE 0 END) AS BIGINT) AS n_{k}" for k in ks)}
        FROM lw GROUP BY word),
s AS (SELECT *, CAST(n_0 + n_1 + n_2 + n_3 AS DOUBLE) AS w, t0 + t1 + t2 + t3 AS t,
             CAST(t0 > 0 AS INT) + CAST(t1 > 0 AS INT) + CAST(t2 > 0 AS INT) + CAST(t3 > 0 AS INT) - 1 AS df
      FROM per CROSS JOIN tot),
u AS (SELECT *, greatest(2 * ({g}), 0) AS g, [{over}] AS over FROM s)""") + f"""
SELECT word, n_0, n_1, n_2, n_3, round(g, 6) AS g,
       CASE WHEN df < 1 THEN NULL WHEN g <= 0 THEN {dbl(1)} WHEN g > 400 THEN {dbl(0)}
            ELSE round(greatest(1 - list_sum(list_transform(range(0, 600), lambda k:
                exp((df / {dbl(2)} + k) * ln(g / 2) - g / 2 - lgamma(df / {dbl(2)} + k + 1)))), 0), 6) END AS pval,
       CAST(list_position(over, list_max(over)) - 1 AS BIGINT) AS top_level
FROM u"""

    # tf-idf ---------------------------------------------------------------
    tf_ctes = sents + f""",
clean AS (SELECT doc_id, sent_no, {strip_special('text')} AS text FROM docs),
toks AS (SELECT doc_id, sent_no, {tokens('text')} AS tk FROM clean),
lens AS (SELECT doc_id, sent_no, len(tk) AS doc_length FROM toks),
cnts AS (SELECT doc_id, sent_no, term, count(*) AS cnt FROM (SELECT doc_id, sent_no, lower(unnest(tk)) AS term FROM toks) GROUP BY ALL),
tf AS (SELECT c.doc_id, c.sent_no, c.term, c.cnt, l.doc_length, c.cnt / l.doc_length AS tf
       FROM cnts c JOIN lens l ON l.doc_id = c.doc_id AND l.sent_no = c.sent_no),
idf AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM clean) / count(*)) AS idf FROM tf GROUP BY term)"""
    o["a13_term_frequency"] = with_(tf_ctes) + "SELECT doc_id, sent_no, term, cnt, doc_length, round(tf, 6) AS tf FROM tf"
    o["a14_document_frequency"] = with_(tf_ctes) + "SELECT term, df, round(idf, 6) AS idf FROM idf"
    o["r11_tfidf"] = with_(tf_ctes) + """
SELECT t.doc_id, t.sent_no, t.term, round(t.tf, 6) AS tf, round(i.idf, 6) AS idf, round(t.tf * i.idf, 6) AS tfidf
FROM tf t JOIN idf i ON i.term = t.term"""

    # report -------------------------------------------------------------------
    li = "li AS (SELECT l_orderkey * 10 + l_linenumber AS fips, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)"
    tops = " UNION ALL ".join(
        f"SELECT fips, {i} AS level, {c} AS pct FROM li" for i, c in enumerate(J.LINEITEM_LEVELS))
    o["w1_top_regions"] = with_(li) + f"""
SELECT fips, CAST(level AS BIGINT) AS level, round(pct, 6) AS pct, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY level ORDER BY pct DESC, fips ASC) AS rank FROM ({tops}))
WHERE rank <= 10"""
    o["w3_order_by_level"] = with_(li) + "SELECT fips, " + ", ".join(
        f"round({c}, 6) AS {c}" for c in J.LINEITEM_LEVELS) + " FROM li ORDER BY l_extendedprice DESC, fips"
    edges = f"""
lng AS ({tops.replace(' AS pct', ' AS value')}),
mm AS (SELECT level, min(value) AS lo, max(value) AS hi FROM lng GROUP BY level),
ed AS (SELECT level, lo, hi, i AS edge_no,
              CASE WHEN i = 15 THEN hi ELSE i * ((hi - lo) / 15) + lo END AS edge
       FROM mm, range(16) t(i))"""
    o["m6_bin_edges"] = with_(li, edges) + \
        "SELECT CAST(level AS BIGINT) AS level, round(lo, 6) AS lo, round(hi, 6) AS hi, CAST(edge_no AS BIGINT) AS edge_no, round(edge, 6) AS edge FROM ed"
    bins = []
    for kind, prefix in (("actual", "y"), ("predicted", "pred_")):
        lng = " UNION ALL ".join(f"SELECT fip, {k} AS level, {prefix}{k} AS value FROM ev" for k in range(4))
        bins.append(f"""
{kind}_l AS ({lng}),
{kind}_m AS (SELECT level, min(value) AS lo, max(value) AS hi FROM {kind}_l GROUP BY level),
{kind}_e AS (SELECT level, CASE WHEN i = 15 THEN hi ELSE i * ((hi - lo) / 15) + lo END AS edge FROM {kind}_m, range(16) t(i)),
{kind}_b AS (SELECT l.fip, l.level, l.value, (SELECT count(*) FROM {kind}_e e WHERE e.level = l.level AND e.edge <= l.value) AS bin,
                    '{kind}' AS kind FROM {kind}_l l)""")
    o["x9_level_bins"] = with_(*x2_ctes(), *bins) + """
SELECT fip, CAST(level AS BIGINT) AS level, round(value, 6) AS value, CAST(bin AS BIGINT) AS bin, kind FROM actual_b
UNION ALL
SELECT fip, CAST(level AS BIGINT) AS level, round(value, 6) AS value, CAST(bin AS BIGINT) AS bin, kind FROM predicted_b"""
    return o

