"""DuckDB SQL with the rows of each query over tournament usage."""

from __future__ import annotations

from podium.functions import names
from podium.sources.orders_adapter import USAGE_SQL

RATCHET = r"regexp_replace(ratchet, '^[A-Za-z]*(\d+-\d+)$', '\1')"
POINTS = "CASE place WHEN 1 THEN 3.0 WHEN 2 THEN 2.0 WHEN 3 THEN 1.0 ELSE 0.0 END"
STAGE = "CASE stage WHEN 'first' THEN 0.5 WHEN 'both' THEN 1.15 ELSE 1.0 END"
DAYS = "date_diff('day', tournament_date, (SELECT max(tournament_date) FROM u))"



def case(column: str, table: dict[str, str]) -> str:
    return f"CASE {column}" + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {column} END"


def scored(usage: str = USAGE_SQL) -> str:
    """Scored usage: c by the 90-day rules under raw names; by the 30-day rules r under raw names, s under display names, y
    with full blade names and labels, and x with the valid combos of y."""
    blade, bit = case("blade", names.BLADE_DISPLAY), case("bit", names.BIT_DISPLAY)
    needs = ", ".join(f"'{b}'" for b in names.NEEDS_LOCK_CHIP)
    return f"""WITH {usage},
c AS (SELECT *, {DAYS} AS days, CAST({POINTS} AS DOUBLE) * power(0.5, greatest({DAYS}, 0) / 90.0) AS ws FROM u),
r AS (SELECT *, {DAYS} AS days, CAST({POINTS} AS DOUBLE) * CAST({STAGE} AS DOUBLE) AS p,
             CAST({POINTS} AS DOUBLE) * CAST({STAGE} AS DOUBLE) * power(0.5, greatest({DAYS}, 0) / 30.0) AS ws FROM u),
s AS (SELECT * REPLACE ({RATCHET} AS ratchet, {blade} AS blade, {bit} AS bit) FROM r),
t0 AS (SELECT * REPLACE (concat_ws(' ', nullif(lock_chip, ''), blade) AS blade), blade AS raw_blade FROM s),
y AS (SELECT *, concat_ws(' ', blade, assist, ratchet, bit) AS combo FROM t0),
x AS (SELECT * FROM y WHERE NOT (raw_blade IN ({needs}) AND lock_chip IS NULL))
"""


WITH = scored()
#: The usage with aliased, chip-less and mixed-case names in place of some (see registry.named_usage).
NAMED_SQL = USAGE_SQL.replace("\nu AS (SELECT", "\nu0 AS (SELECT") + """,
u AS (SELECT * REPLACE (CASE blade WHEN 'Brand#11' THEN 'Soar Phoenix' WHEN 'Brand#12' THEN 'Dark' WHEN 'Brand#13' THEN 'DARK' ELSE blade END AS blade,
      CASE bit WHEN 'PROMO' THEN 'BS' WHEN 'ECONOMY' THEN 'economy' ELSE bit END AS bit) FROM u0)"""
NAMED = scored(NAMED_SQL)


def count(when: str) -> str:
    return f"CAST(sum(CASE WHEN {when} THEN 1 ELSE 0 END) AS BIGINT)"


def total(col: str, when: str = "true") -> str:
    return f"round(coalesce(sum(CASE WHEN {when} THEN {col} ELSE 0.0 END), 0.0), 6)"


PLACES = f"{count('place = 1')} AS first, {count('place = 2')} AS second, {count('place = 3')} AS third"


def cli(keys: str, limit: int, least: int) -> str:
    return WITH + f"""
SELECT *, raw_score / uses AS avg_score,
       round(CASE WHEN older_score > 0 THEN recent_score / greatest(older_score, 0.1) - 1
                  WHEN recent_score > 0 THEN 1.0 ELSE 0.0 END, 6) AS trend
FROM (SELECT {keys}, {total('ws')} AS raw_score, {total('ws', 'days <= 30')} AS recent_score,
             {total('ws', 'days > 30')} AS older_score, count(*) AS uses, {PLACES} FROM c GROUP BY ALL)
WHERE uses >= {least} ORDER BY raw_score DESC, {keys} LIMIT {limit}"""


TREND = """round(CASE WHEN ru > 0 AND ou > 0 THEN (rs / ru - os / ou) / nullif(os / ou, 0) WHEN ru > 0 THEN 0.5
    WHEN ou > 0 THEN -least(0.5, ou * 0.1) ELSE 0.0 END, 6)"""


def ranked(keys: str, select: str, src: str, limit: int, least: int) -> str:
    """A ranking by the 30-day rules, without rank, as a subquery."""
    return f"""(SELECT {keys}, raw_score, uses, first, second, third, raw_score / uses AS avg_score,
       {TREND} AS trend
FROM (SELECT {select}, {total('ws')} AS raw_score, count(*) AS uses, {PLACES},
             {total('ws', 'days <= 30')} AS rs, {count('days <= 30')} AS ru,
             {total('ws', 'days > 30 AND days <= 60')} AS os, {count('days > 30 AND days <= 60')} AS ou
      FROM {src} GROUP BY ALL)
WHERE uses >= {least} ORDER BY raw_score DESC, {keys} LIMIT {limit})"""


TIER = """CASE WHEN q < 3 THEN 'SS' WHEN q < 13 THEN 'S' WHEN q < 30 THEN 'A' WHEN q < 50 THEN 'B' WHEN q < 70 THEN 'C'
    WHEN q < 97 THEN 'D' ELSE 'F' END"""


def tiered(keys: str, sub: str, tiers: bool = True) -> str:
    tier = f", {TIER} AS tier" if tiers else ""
    return f"""(SELECT * EXCLUDE (q, rank), CAST(rank AS INTEGER) AS rank{tier} FROM (SELECT *, (rank - 1) * 100.0 / count(*) OVER () AS q
FROM (SELECT *, row_number() OVER (ORDER BY raw_score DESC, {keys}) AS rank FROM {sub})))"""


BLADE, COMBO = "blade, series", "combo, blade, ratchet, bit, lock_chip, assist"
BLADES = lambda src="s", limit=20, least=3: tiered(BLADE, ranked(BLADE, BLADE, src, limit, least))
COMBOS = lambda limit=20, least=2: tiered(COMBO, ranked(COMBO, COMBO, "x", limit, least))


def part(name: str, limit: int = 15, least: int = 3, rank: bool = True) -> str:
    sub = ranked("name", f"{name} AS name", f"(SELECT * FROM s WHERE {name} IS NOT NULL)", limit, least)
    return WITH + "SELECT * FROM " + (tiered("name", sub, False) if rank else sub)


def best(where: str, keys: str, src: str = "s", avg: bool = True, start: str | None = None) -> str:
    more = ", raw_score / uses AS avg_score" if avg else ""
    return (start or WITH) + f"""SELECT *{more} FROM (SELECT {keys}, {total('ws')} AS raw_score, count(*) AS uses, {PLACES}
FROM {src} WHERE {where} GROUP BY ALL) ORDER BY raw_score DESC, {keys} LIMIT 10"""


def sides(src: str, is_a: str, is_b: str, a: str, b: str) -> str:
    return f"""
z AS (SELECT *, 0 AS side, '{a}' AS name FROM {src} WHERE {is_a} UNION ALL SELECT *, 1 AS side, '{b}' AS name FROM {src} WHERE {is_b}),
tot AS (SELECT side, name, {total('ws')} AS raw_score, count(*) AS uses, {PLACES},
        round({count('place = 1')} / CAST(count(*) AS DOUBLE), 6) AS win_rate, round(avg(place), 6) AS avg_place
        FROM z GROUP BY side, name),
bst AS (SELECT min(CASE WHEN side = 0 THEN place END) AS a, min(CASE WHEN side = 1 THEN place END) AS b
        FROM z GROUP BY tournament_id),
met AS (SELECT count(*) AS met, coalesce({count('a < b')}, 0) AS aw, coalesce({count('b < a')}, 0) AS bw,
        coalesce({count('a = b')}, 0) AS tied FROM bst WHERE a IS NOT NULL AND b IS NOT NULL),
cmp AS (SELECT tot.* EXCLUDE (side), met, CASE WHEN side = 0 THEN aw ELSE bw END AS won,
        CASE WHEN side = 0 THEN bw ELSE aw END AS lost, tied FROM tot, met)
"""


def weekly(key: str, weeks: int = 7) -> str:
    return WITH + f""", w AS (SELECT *, concat_ws(' ', blade, ratchet, bit) AS combo,
       CAST({weeks} - 1 - floor(days / 7.0) AS INTEGER) AS week_idx FROM s WHERE days >= 0 AND floor(days / 7.0) < {weeks}),
spine AS (SELECT {key}, CAST(i AS INTEGER) AS week_idx FROM (SELECT DISTINCT {key} FROM w), (SELECT unnest(range({weeks})) AS i)),
agg AS (SELECT {key}, week_idx, {total('p')} AS score, count(*) AS uses FROM w GROUP BY ALL),
wk AS (SELECT spine.{key}, spine.week_idx, coalesce(score, 0.0) AS score, CAST(coalesce(uses, 0) AS BIGINT) AS uses
       FROM spine LEFT JOIN agg ON spine.{key} = agg.{key} AND spine.week_idx = agg.week_idx)
"""


def era(n: int) -> str:
    cases = " ".join(
        f"WHEN date_diff('day', lo, tournament_date) * {n} <= date_diff('day', lo, hi) * {i} THEN {i - 1}" for i in range(1, n)
    )
    return f""", e AS (SELECT s.*, concat_ws(' ', blade, ratchet, bit) AS combo, CAST(CASE {cases} ELSE {n - 1} END AS INTEGER) AS era
FROM s, (SELECT min(tournament_date) AS lo, max(tournament_date) AS hi FROM u))
"""


GEM = "blade, ratchet, bit, lock_chip"
_ERAS = ", ".join(
    f"{count(f'era = {i}')} AS {n}_uses, {count(f'era = {i} AND place = 1')} AS {n}_wins, {total('p', f'era = {i}')} AS {n}_score"
    for i, n in enumerate(("early", "mid", "current"))
)
GEMS = WITH + era(3) + f""", g AS (SELECT {GEM}, count(*) AS uses, {count('place = 1')} AS wins, {total('ws')} AS score,
  round(avg(place), 6) AS avg_place, {_ERAS}, {count('days <= 60')} AS last60_uses,
  {count('days <= 60 AND place = 1')} AS last60_wins, {total('p', 'days <= 60')} AS last60_score,
  {count('days <= 90')} AS last90_uses FROM e GROUP BY ALL),
pk AS (SELECT {GEM}, tournament_date AS peak_date FROM (SELECT *, row_number() OVER (PARTITION BY {GEM}
       ORDER BY round(ws, 6) DESC, tournament_date) AS k FROM e) WHERE k = 1),
gs AS (SELECT g.*, pk.peak_date FROM g JOIN pk ON g.blade = pk.blade AND g.ratchet = pk.ratchet AND g.bit = pk.bit
       AND g.lock_chip IS NOT DISTINCT FROM pk.lock_chip),
meta AS (SELECT DISTINCT blade FROM (SELECT * FROM gs WHERE current_uses >= 3
         ORDER BY current_score DESC, blade, ratchet, bit, lock_chip NULLS FIRST LIMIT 10)),
gt AS (SELECT *, CASE WHEN early_score >= mid_score AND early_score >= current_score THEN 'early'
                      WHEN mid_score >= current_score THEN 'mid' ELSE 'current' END AS peak_era,
       CASE WHEN uses <= last90_uses AND last60_uses > 0 THEN 'rising'
            WHEN early_uses + mid_uses >= 3 AND early_wins + mid_wins >= 0.25 * (early_uses + mid_uses)
                 AND last60_uses = 0 AND last90_uses > 0 THEN 'returning'
            WHEN last60_uses >= 2 AND current_score > mid_score THEN 'rising'
            WHEN last60_uses = 0 AND last90_uses = 0 THEN 'falling' ELSE 'stable' END AS gtrend FROM gs)
"""


def quality(n: str, strong: int, moderate: int) -> str:
    return f"CASE WHEN {n} >= {strong} THEN 'strong' WHEN {n} >= {moderate} THEN 'moderate' ELSE 'limited' END"


def monthly(key: str) -> str:
    return f"""(SELECT *, CAST(row_number() OVER (PARTITION BY month ORDER BY score DESC, name) AS INTEGER) AS rank
FROM (SELECT strftime(tournament_date, '%Y-%m') AS month, {key} AS name, {total('p')} AS score FROM s GROUP BY ALL))"""


NAME = "concat_ws(' ', blade, ratchet, bit)"
GEM_ORDER = "blade, ratchet, bit, lock_chip NULLS FIRST"


def stack(kinds: tuple[str, ...], src: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS kind, {k} AS name, place FROM {src}" for k in kinds)


KINDS = ("blade", "ratchet", "bit", "assist", "lock_chip")
WIN3 = "round(" + count("place = 1") + " / CAST(count(*) AS DOUBLE), 3)"


def summary(where: str) -> str:
    return f"""WITH {USAGE_SQL} SELECT count(DISTINCT tournament_id) AS tournaments,
count(DISTINCT tournament_id || '|' || place) AS placements, count(*) AS combo_uses, count(DISTINCT player_name) AS players,
count(DISTINCT blade) AS blades, min(tournament_date) AS first_date, max(tournament_date) AS last_date FROM u WHERE {where}"""


def snapshot(label: str) -> str:
    top = lambda k: f"""(SELECT '{k}' AS kind, {k} AS name, count(*) AS uses, {count('place = 1')} AS wins FROM n
GROUP BY ALL ORDER BY uses DESC, wins DESC, name LIMIT 10)"""  # noqa: E731
    return f"""WITH {USAGE_SQL}, n AS (SELECT *, {label} AS combo FROM u
WHERE tournament_date >= (SELECT max(tournament_date) FROM u) - 30)
SELECT t.*, (SELECT count(DISTINCT tournament_id) FROM n) AS tournaments FROM ({top('blade')} UNION ALL {top('combo')}) t"""


COMPARE_C = WITH + "," + sides("c", "blade = 'Brand#2'", "blade = 'Brand#3'", "Brand#2", "Brand#3")
COMPARE_S = WITH + "," + sides("s", "blade = 'Brand#2'", "blade = 'Brand#3'", "Brand#2", "Brand#3")


def combos(usage: str, a: tuple, b: tuple) -> str:
    columns = ("blade", "ratchet", "bit", "lock_chip", "assist")
    same = lambda x: " AND ".join(f"lower({c}) = '{v.lower()}'" for c, v in zip(columns, x, strict=False) if v)
    label = lambda x: " ".join(v for v in (*x[3:4], x[0], *x[4:5], x[1] + x[2]) if v)
    return scored(usage) + "," + sides("r", same(a), same(b), label(a), label(b)) + "SELECT * FROM cmp"


def share(c: str) -> str:
    return f"round(coalesce({c} * 100.0 / nullif(sum({c}) OVER (), 0), 50.0), 4)"


def top_names(kind: str, k: int) -> str:
    return f"(SELECT {kind} FROM s GROUP BY {kind} ORDER BY count(*) DESC, {kind} LIMIT {k})"


def matrix(kind: str, k: int) -> str:
    return f"""SELECT b.blade, '{kind}' AS kind, r.{kind} AS part, CAST(coalesce(uses, 0) AS BIGINT) AS uses, coalesce(win_rate, 0.0) AS win_rate
FROM {top_names('blade', 10)} b CROSS JOIN {top_names(kind, k)} r LEFT JOIN (SELECT blade, {kind}, count(*) AS uses,
round({count('place = 1')} / CAST(count(*) AS DOUBLE), 6) AS win_rate FROM s GROUP BY ALL) a ON a.blade = b.blade AND a.{kind} = r.{kind}"""




def spotlight(usage: str, where: str = "true", today: str | None = None) -> str:
    newest = "(SELECT max(tournament_date) FROM u)"
    return scored(usage) + f""", q AS (SELECT days <= 30 AS recent, combo, {total('p')} AS score, count(*) AS uses, {count('place = 1')} AS wins
FROM y WHERE days <= 60 GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY recent ORDER BY score DESC, combo) AS INTEGER) AS rank, sum(uses) OVER (PARTITION BY recent) AS total FROM q),
f AS (SELECT combo, score, uses, CAST(floor(wins * 100.0 / uses + 0.5) AS BIGINT) AS win_rate,
             CAST(floor(uses * 100.0 / total + 0.5) AS BIGINT) AS dominance, rank AS new_rank FROM k WHERE recent),
m AS (SELECT f.*, o.rank - f.new_rank AS change, o.rank AS old_rank FROM f JOIN k o ON o.combo = f.combo AND NOT o.recent WHERE abs(o.rank - f.new_rank) >= 3)
SELECT *, (SELECT max(tournament_date) FROM u WHERE {where}) AS last_date,
  date_diff('day', (SELECT max(tournament_date) FROM u WHERE {where}), {today or f"(SELECT max(tournament_date) FROM u WHERE {where})"}) > 30 AS is_stale
FROM ((SELECT 'champion' AS kind, *, 0 AS change FROM f WHERE uses >= 2 ORDER BY score DESC, combo LIMIT 1)
UNION ALL (SELECT 'riser', * EXCLUDE (old_rank) FROM m WHERE change > 0 ORDER BY change DESC, new_rank LIMIT 3)
UNION ALL (SELECT 'faller', * EXCLUDE (old_rank) FROM m WHERE change < 0 ORDER BY change, old_rank LIMIT 3))"""


_RD = f""", rd AS (SELECT * REPLACE ({case('bit', names.BIT_DISPLAY)} AS bit), bit AS raw_bit FROM r)
"""
NAMED_RD, PLAIN_RD = NAMED + _RD, WITH + _RD


def series(usage: str, where: str, weeks: int = 7) -> str:
    return scored(usage) + f"""SELECT CAST(i AS INTEGER) AS week_idx, coalesce(score, 0.0) AS score FROM (SELECT unnest(range({weeks})) AS i)
LEFT JOIN (SELECT {weeks} - 1 - floor(days / 7.0) AS w, {total('p')} AS score FROM r WHERE {where} AND days >= 0 AND floor(days / 7.0) < {weeks} GROUP BY 1) ON w = i"""


def as_of(day: str, region: str | None = None) -> str:
    """Scored usage as it stood on a day, of one region."""
    more = f" AND region = '{region}'" if region else ""
    usage = USAGE_SQL.replace("\nu AS (SELECT", "\nu0 AS (SELECT") + f""",
u AS (SELECT * FROM u0 WHERE tournament_date <= DATE '{day}'{more})"""
    own = f"DATE '{day}'" if day < "2100" else "(SELECT max(tournament_date) FROM u0)"
    return scored(usage).replace("(SELECT max(tournament_date) FROM u)", own)


ORACLE_SQL: dict[str, str] = {
    "view_usage": f"WITH {USAGE_SQL} SELECT * FROM u",
    "view_part_stats": f"""WITH {USAGE_SQL}, k AS ({stack(KINDS, 'u')}) SELECT name AS part_name, kind AS part_type,
count(*) AS total, {PLACES}, {WIN3} AS win_rate FROM k WHERE name IS NOT NULL OR kind IN ('blade', 'ratchet', 'bit') GROUP BY ALL""",
    "view_combo_stats": f"""WITH {USAGE_SQL} SELECT lock_chip, blade, ratchet, bit,
concat_ws(' ', lock_chip, blade, ratchet || bit) AS combo, count(*) AS total, {count('place = 1')} AS first, {WIN3} AS win_rate FROM u GROUP BY ALL""",
    "rank_combos_cli": cli("blade, ratchet, bit", 20, 2),
    "rank_blades_cli": cli("blade", 20, 3),
    "rank_ratchets_cli": cli("ratchet", 15, 3),
    "rank_bits_cli": cli("bit", 15, 3),
    "rank_blades": WITH + "SELECT * FROM " + BLADES(),
    "rank_blades_region": WITH + "SELECT * FROM " + BLADES("(SELECT * FROM s WHERE region = 'ASIA')"),
    "rank_combos": WITH + "SELECT * FROM " + COMBOS(),
    "rank_ratchets": part("ratchet"),
    "rank_bits": part("bit"),
    "rank_assists": part("assist", least=2, rank=False),
    "rank_lock_chips": part("lock_chip", least=2, rank=False),
    "rank_blades_by_series": WITH + "SELECT * FROM " + BLADES(limit=200, least=2) + " WHERE series = 'BX' ORDER BY rank LIMIT 50",
    "top_by_series": WITH + f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY series ORDER BY rank) AS INTEGER) AS series_rank
FROM {BLADES(limit=200, least=2)}) WHERE series_rank <= 5""",
    "rank_unique_blade": WITH + f"""SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY blade ORDER BY rank) AS k
FROM {COMBOS(limit=500)}) WHERE k = 1""",
    "rank_search": WITH + f"""SELECT * FROM {ranked(COMBO, COMBO, 'x', 100000000, 1)} WHERE (lower(combo) LIKE '%econ%'
OR lower(ratchet) LIKE '%econ%' OR lower(bit) LIKE '%econ%') AND regexp_extract(ratchet, '-(\\d+)', 1) = '60'
ORDER BY raw_score DESC, combo, blade, ratchet, bit, lock_chip NULLS FIRST, assist NULLS FIRST LIMIT 50""",
    "best_for_blade_cli": best("lower(blade) = 'brand#2'", "ratchet, bit", "c", avg=False),
    "best_for_blade": best("lower(blade) = 'brand#2'", "ratchet, bit"),
    "best_for_ratchet": best("lower(ratchet) = '10-60'", "blade, bit", "rd", start=PLAIN_RD),
    "best_for_bit": best("lower(raw_bit) = 'economy'", "blade, ratchet", f"(SELECT * REPLACE ({RATCHET} AS ratchet) FROM rd)", start=PLAIN_RD),
    "top_parts_stats": f"""WITH {USAGE_SQL} SELECT * FROM (
(SELECT 'blade' AS kind, blade AS name, count(*) AS total FROM u GROUP BY ALL ORDER BY total DESC, name LIMIT 10)
UNION ALL (SELECT 'combo', concat_ws(' ', lock_chip, blade, ratchet || bit) AS name, count(*) AS total FROM u
           GROUP BY lock_chip, blade, ratchet, bit ORDER BY total DESC, name LIMIT 10)
UNION ALL (SELECT 'region', coalesce(region, 'Unknown'), count(DISTINCT tournament_id) FROM u GROUP BY ALL)
UNION ALL (SELECT 'source', source, count(DISTINCT tournament_id) FROM u GROUP BY ALL))""",
    "recent_by_source": f"""WITH {USAGE_SQL} SELECT DISTINCT tournament_id, tournament_date FROM u WHERE source = '1'
ORDER BY tournament_date DESC, tournament_id LIMIT 5""",
    "summary": summary("true"),
    "summary_region": summary("region = 'EUROPE'"),
    "snapshot": snapshot("blade || ' ' || ratchet || ' ' || bit"),
    "snapshot_cli": snapshot("blade || ' ' || ratchet || bit"),
    "combo_stats_point": WITH + f"""SELECT 'Brand#2 10-60ECONOMY' AS combo, round({total('ws')}, 2) AS raw_score,
count(*) AS uses, {PLACES}, round(coalesce((first + 2 * second + 3 * third) / CAST(nullif(first + second + third, 0) AS DOUBLE), 0.0), 2) AS avg_placement
FROM r WHERE blade = 'Brand#2' AND ratchet = '10-60' AND bit = 'ECONOMY' HAVING count(*) > 0""",
    "distinct_parts": WITH + f"SELECT DISTINCT kind, name FROM ({stack(KINDS, 's')}) WHERE name IS NOT NULL",
    "compare_blades_cli": COMPARE_C + "SELECT * FROM cmp",
    "compare_blades": COMPARE_S + "SELECT * FROM cmp",
    "compare_combos": combos(USAGE_SQL, ("Brand#2", "10-60", "ECONOMY"), ("Brand#3", "11-80", "STANDARD")),
    "compare_combos_named": combos(NAMED_SQL, ("dark", "h1-80", "Economy"), ("Dark", "H1-80", "ECONOMY", "o")),
    "compare_combos_stored": combos(NAMED_SQL, ("dark", "49-80", "Economy", "o"), ("Dark", "h50-60", "MEDIUM", "f", None)),
    "compare_share": COMPARE_S + f"""SELECT name, {share('raw_score')} AS score_share, {share('uses')} AS use_share,
{share('first')} AS win_share, {share('inv')} AS place_share FROM (SELECT *, greatest(4 - avg_place, 0.0) AS inv FROM cmp)""",
    "hidden_gems": WITH + f"""SELECT blade, ratchet, bit, uses, round(w, 6) AS win_rate, round(score / uses, 6) AS avg_score,
round((w * 40 + t * 30 + score / uses * 5) * greatest(1.0, log2(20.0 / uses)) * CASE WHEN ru > 0 THEN 1.2 ELSE 1.0 END, 4) AS potential,
CASE WHEN ru >= 2 AND ou >= 2 THEN CASE WHEN rs / ru > os / ou * 1.15 THEN 'up' WHEN rs / ru < os / ou * 0.85 THEN 'down' ELSE 'stable' END
     WHEN ru >= 2 AND ou = 0 THEN 'up' ELSE 'stable' END AS trend
FROM (SELECT *, wins / CAST(uses AS DOUBLE) AS w, pods / CAST(uses AS DOUBLE) AS t FROM (SELECT blade, ratchet, bit, count(*) AS uses,
 {count('place = 1')} AS wins, {count('place <= 3')} AS pods, {total('ws')} AS score, {count('days <= 60')} AS ru, {total('p', 'days <= 60')} AS rs,
 {count('days > 60 AND days <= 90')} AS ou, {total('p', 'days > 60 AND days <= 90')} AS os FROM s GROUP BY ALL))
WHERE uses BETWEEN 4 AND 20 AND w >= 0.2 AND t >= 0.4 ORDER BY potential DESC, blade, ratchet, bit LIMIT 20""",
    "eras3": WITH + era(3) + f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY era ORDER BY score DESC, {GEM_ORDER}) AS INTEGER) AS rank
FROM (SELECT era, {GEM}, {total('p')} AS score, count(*) AS uses FROM e GROUP BY ALL) WHERE uses >= 2) WHERE rank <= 5""",
    "gem_stats": GEMS + "SELECT * FROM gs",
    "gems_underused": GEMS + f"""SELECT b.blade, ratchet, bit, lock_chip, bu AS total_uses, round(bw / CAST(bu AS DOUBLE), 6) AS win_rate, ru AS recent_uses,
{quality('bu', 15, 8)} AS data_quality, peak_era, gtrend AS trend,
b.blade || ' has ' || CAST(floor(bw / CAST(bu AS DOUBLE) * 100 + 0.5) AS INTEGER) || '% win rate ' || CASE ru WHEN 0 THEN 'with no recent appearances' WHEN 1 THEN 'but only 1 recent appearance'
  ELSE 'but only ' || ru || ' recent appearances' END AS reason, 'Best combo shown above. This blade is undervalued in current meta.' AS insight
FROM (SELECT blade, CAST(sum(uses) AS BIGINT) AS bu, CAST(sum(wins) AS BIGINT) AS bw, CAST(sum(last60_uses) AS BIGINT) AS ru FROM gt GROUP BY blade) b
JOIN (SELECT *, row_number() OVER (PARTITION BY blade ORDER BY score DESC, ratchet, bit, lock_chip NULLS FIRST) AS k FROM gt) t ON t.blade = b.blade AND k = 1
WHERE bu >= 5 AND bw >= 0.1 * bu AND ru <= 5000 AND b.blade NOT IN (SELECT blade FROM meta)
ORDER BY win_rate DESC, total_uses DESC, b.blade LIMIT 8""",
    "gems_forgotten": GEMS + f"""SELECT {GEM}, early_uses + mid_uses AS total_uses, early_wins + mid_wins AS past_wins,
round((early_wins + mid_wins) / CAST(early_uses + mid_uses AS DOUBLE), 6) AS win_rate, {quality('early_uses + mid_uses', 8, 4)} AS data_quality,
peak_era, peak_date, 'Won ' || (early_wins + mid_wins) || ' tournament' || CASE WHEN early_wins + mid_wins = 1 THEN '' ELSE 's' END || ' in ' || peak_era || ' era' AS reason,
'Former champion with ' || CAST(floor((early_wins + mid_wins) / CAST(early_uses + mid_uses AS DOUBLE) * 100 + 0.5) AS INTEGER) || '% past win rate - meta may have moved on prematurely' AS insight,
CASE WHEN last90_uses > 0 THEN 'returning' ELSE 'stable' END AS trend
FROM gt WHERE early_wins + mid_wins >= 1 AND early_uses + mid_uses >= 2 AND current_uses <= 3 AND last60_uses <= 2
ORDER BY past_wins DESC, win_rate DESC, {GEM_ORDER} LIMIT 8""",
    "gems_rising": GEMS + f"""SELECT {GEM}, last60_uses AS recent_uses, last60_wins AS recent_wins,
round(last60_wins / CAST(last60_uses AS DOUBLE), 6) AS recent_win_rate, last60_score AS recent_score, {quality('last60_uses', 6, 3)} AS data_quality,
'New combo with ' || last60_wins || ' win' || CASE WHEN last60_wins = 1 THEN '' ELSE 's' END || ' in last 60 days' AS reason,
'Emerging pick gaining traction - could be next meta contender' AS insight
FROM gt WHERE current_uses >= 0.6 * uses AND last60_uses >= 2 AND last60_wins >= 1 AND uses <= 60
ORDER BY recent_win_rate DESC, recent_uses DESC, {GEM_ORDER} LIMIT 8""",
    "gems_counter_meta": GEMS + f"""SELECT {GEM}, current_uses AS total_uses, current_wins,
round(current_wins / CAST(current_uses AS DOUBLE), 6) AS win_rate, {quality('current_uses', 6, 3)} AS data_quality, gtrend AS trend,
CASE current_wins WHEN 0 THEN 'Non-meta blade placing well in current era' WHEN 1 THEN 'Non-meta blade with 1 win in current era'
  ELSE 'Non-meta blade with ' || current_wins || ' wins in current era' END AS reason, 'Could exploit weaknesses in popular meta choices' AS insight
FROM gt WHERE current_uses >= 2 AND (current_wins >= 1 OR 4 * current_wins >= current_uses) AND last90_uses >= 2 AND blade NOT IN (SELECT blade FROM meta)
ORDER BY current_wins DESC, win_rate DESC, {GEM_ORDER} LIMIT 8""",
    "part_analysis": WITH + f"""SELECT blade AS name, count(*) AS uses, round({count('place = 1')} / CAST(count(*) AS DOUBLE), 6) AS win_rate,
round(avg(place), 6) AS avg_place, count(DISTINCT blade || '|' || ratchet || '|' || bit) AS versatility,
round({count(f"ratchet IN {top_names('blade', 10)} OR bit IN {top_names('blade', 10)}")} / CAST(count(*) AS DOUBLE), 6) AS synergy_same,
round({count(f"ratchet IN {top_names('ratchet', 10)} OR bit IN {top_names('bit', 10)}")} / CAST(count(*) AS DOUBLE), 6) AS synergy_other,
round(1 / (1 + stddev_pop(place)), 6) AS consistency FROM s GROUP BY blade HAVING count(*) >= 3""",
    "variance": WITH + """SELECT *, std_dev > round(avg_score * 0.5, 6) AS high_variance FROM (SELECT blade, ratchet, bit, count(*) AS uses,
round(avg(ws), 6) AS avg_score, round(var_pop(ws), 6) AS variance, round(stddev_pop(ws), 6) AS std_dev, round(max(ws), 6) AS ceiling,
round(min(ws), 6) AS floor FROM s GROUP BY ALL) WHERE uses >= 3""",
    "part_matrix": WITH + matrix("ratchet", 8) + " UNION ALL " + matrix("bit", 10),
    "landscape": WITH + f"""SELECT blade, series, uses, round(first / CAST(uses AS DOUBLE) * 100, 4) AS first_pct,
round(score / nullif(max(score) OVER (), 0) * 20 + 4, 4) AS radius, round(uses / 100.0 * (first / CAST(uses AS DOUBLE)), 4) AS champion_share,
round(uses * 100.0 / max(uses) OVER (), 4) AS bar_pct
FROM (SELECT blade, series, {total('ws')} AS score, count(*) AS uses, {count('place = 1')} AS first FROM s GROUP BY ALL
      ORDER BY score DESC, blade, series LIMIT 20)""",
    "spark_blade": series(USAGE_SQL, "lower(blade) = 'brand#2'"),
    "spark_blades": weekly("blade") + "SELECT * FROM wk",
    "spark_combos": weekly("combo") + "SELECT * FROM wk",
    "rising_trends": weekly("blade", 8) + """SELECT blade, uses, growth_rate, round((r - m) - (m - o), 6) AS momentum,
round(r / 4 * (1 + growth_rate / 100), 6) AS projected FROM (SELECT *, round(CASE WHEN o > 0 THEN (r - o) / o * 100 WHEN r > 0 THEN 100.0 ELSE 0.0 END, 6) AS growth_rate
FROM (SELECT blade, CAST(sum(uses) AS BIGINT) AS uses, round(sum(CASE WHEN week_idx >= 4 THEN score ELSE 0.0 END), 6) AS r,
round(sum(CASE WHEN week_idx <= 3 THEN score ELSE 0.0 END), 6) AS o, round(sum(CASE WHEN week_idx BETWEEN 2 AND 5 THEN score ELSE 0.0 END), 6) AS m
FROM wk GROUP BY blade)) WHERE uses >= 3 AND growth_rate > 10 ORDER BY growth_rate DESC, blade LIMIT 15""",
    "evolution_eras": WITH + era(4) + " UNION ALL ".join(
        f"""SELECT era, '{k}' AS kind, name, score, wins, uses, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY era ORDER BY score DESC, name) AS rank
FROM (SELECT era, {k} AS name, {total('p')} AS score, {count('place = 1')} AS wins, count(*) AS uses FROM e GROUP BY ALL)) WHERE rank <= {n}"""
        for k, n in (("blade", 5), ("combo", 3))
    ),
    "evolution_timeline": WITH + f"""SELECT t.month, event_dates, tournaments, b.name AS top_blade, c.name AS top_combo FROM
(SELECT strftime(tournament_date, '%Y-%m') AS month, count(DISTINCT tournament_date) AS event_dates, count(DISTINCT tournament_id) AS tournaments FROM u GROUP BY ALL) t
JOIN {monthly('blade')} b ON b.month = t.month AND b.rank = 1 JOIN {monthly(NAME)} c ON c.month = t.month AND c.rank = 1""",
    "evolution_journeys": WITH + f""", mr AS (SELECT * FROM {monthly('blade')}),
mn AS (SELECT month, row_number() OVER (ORDER BY month) AS m, count(*) OVER () AS last FROM (SELECT DISTINCT month FROM mr)),
ow AS (SELECT mr.*, m, last FROM mr JOIN mn USING (month) WHERE name IN (SELECT name FROM mr WHERE rank <= 5)),
jj AS (SELECT name, min(rank) AS peak_rank, min(m) AS fm, max(m) AS lm, max(last) AS last, max(CASE WHEN m = last THEN rank END) AS cur,
       max(CASE WHEN m = last - 1 THEN rank END) AS prev FROM ow GROUP BY name)
SELECT name AS blade, peak_rank, (SELECT min(month) FROM ow WHERE ow.name = jj.name AND ow.rank = jj.peak_rank) AS peak_month, cur AS current_rank,
CASE WHEN fm >= last - 1 THEN 'new' WHEN cur IS NULL AND lm < last - 1 THEN 'gone' WHEN cur < prev - 1 THEN 'rising' WHEN cur > prev + 1 THEN 'falling' ELSE 'stable' END AS trend
FROM jj ORDER BY peak_rank, peak_month, blade LIMIT 10""",
    "spotlight": spotlight(USAGE_SQL),
    "spotlight_named": spotlight(NAMED_SQL),
    "rank_combos_named": NAMED + "SELECT * FROM " + COMBOS(),
    "rank_blades_named": NAMED + "SELECT * FROM " + BLADES(),
    "best_for_ratchet_named": best("lower(ratchet) = 'h10-60'", "blade, bit", "rd", start=NAMED_RD),
    "best_for_bit_named": best("lower(raw_bit) = 'bs'", "blade, ratchet", f"(SELECT * REPLACE ({RATCHET} AS ratchet) FROM rd)", start=NAMED_RD),
    "spark_blade_named": series(NAMED_SQL, "lower(blade) = 'dark'"),
    "spark_combo": series(USAGE_SQL, "lower(blade) = 'brand#2' AND lower(ratchet) = '10-60' AND lower(bit) = 'economy'"),
    "blade_cards": WITH + f"""SELECT blade, rank, CASE WHEN trend > 0.1 THEN 'up' WHEN trend < -0.1 THEN 'down' ELSE 'neutral' END AS trend_class,
CASE WHEN pods = 0 THEN '--' WHEN floor(av + 0.5) <= 1 THEN '1st' WHEN floor(av + 0.5) = 2 THEN '2nd' ELSE '3rd' END AS placement
FROM (SELECT *, first + second + third AS pods, (first + 2 * second + 3 * third) / CAST(nullif(first + second + third, 0) AS DOUBLE) AS av FROM {BLADES(limit=50, least=1)})""",
    "rank_combos_as_of": as_of("1998-06-30") + "SELECT * FROM " + COMBOS(),
    "rank_combos_region": as_of("2100-01-01", "ASIA") + "SELECT * FROM " + COMBOS(),
    "distribution": WITH + """SELECT blade, uses, round(uses * 100.0 / sum(uses) OVER (), 1) AS share FROM (SELECT blade, count(*) AS uses FROM s WHERE days <= 30 GROUP BY ALL)
ORDER BY uses DESC, blade LIMIT 6""",
    "share_monthly": WITH + f""", mc AS (SELECT strftime(tournament_date, '%Y-%m') AS month, {NAME} AS combo, count(*) AS uses FROM s
WHERE tournament_date >= date_trunc('month', (SELECT max(tournament_date) FROM u)) - INTERVAL 5 MONTH GROUP BY ALL),
mk AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY uses DESC, combo) AS k FROM mc),
sh AS (SELECT t.month, c.combo, CAST(floor(coalesce(mc.uses, 0) * 100.0 / t.total + 0.5) AS BIGINT) AS share
       FROM (SELECT month, sum(uses) AS total FROM mc GROUP BY month) t CROSS JOIN (SELECT DISTINCT combo FROM mk WHERE k <= 5) c
       LEFT JOIN mc ON mc.month = t.month AND mc.combo = c.combo)
SELECT * FROM sh UNION ALL SELECT month, 'Others', CAST(greatest(0, 100 - sum(share)) AS BIGINT) FROM sh GROUP BY month""",
    "stream_weekly": """SELECT CAST(DATE '1970-01-01' + CAST(floor(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) / 7.0) * 7 AS INTEGER) AS DATE) AS week,
event_type, count(*) AS uses, round(sum(value), 4) AS points FROM events GROUP BY ALL""",
}


def _part_rates(part: str, limit: int) -> str:
    sub = ranked("name", f"{part} AS name", f"(SELECT * FROM s WHERE {part} IS NOT NULL)", limit, 2)
    return f"r_{part} AS (SELECT name AS {part}, round(first / CAST(uses AS DOUBLE), 6) AS {part}_rate, uses AS {part}_uses FROM {sub})"


_KNOWN = " + ".join(f"CASE WHEN {p}_rate IS NOT NULL THEN 1 ELSE 0 END" for p in ("blade", "ratchet", "bit"))
_RATES = " + ".join(f"coalesce({p}_rate, 0.0)" for p in ("blade", "ratchet", "bit"))
_THEORY = " + ".join(
    f"coalesce({p}_rate * {w} + least({p}_uses, 20) * {u}, 0.0)" for p, w, u in (("blade", 50, 2), ("ratchet", 30, 1), ("bit", 30, 1))
)
DECKS = weekly("combo", 8) + f""",
dk AS (SELECT DISTINCT concat_ws('|', tournament_id, player_name) AS deck_id, blade, ratchet, bit FROM s WHERE place = 1),
own AS (SELECT blade, ratchet, bit, {total('ws')} AS sc, count(*) AS n, {PLACES} FROM s GROUP BY ALL),
{_part_rates('blade', 30)}, {_part_rates('ratchet', 15)}, {_part_rates('bit', 15)},
mt AS (SELECT * FROM {ranked(COMBO, COMBO, 'x', 20, 2)}),
tr AS (SELECT combo, round(sum(CASE WHEN week_idx >= 4 THEN score ELSE 0.0 END), 6) AS late,
       round(sum(CASE WHEN week_idx < 4 THEN score ELSE 0.0 END), 6) AS early FROM wk GROUP BY combo),
j AS (SELECT dk.deck_id, dk.blade, dk.ratchet, dk.bit, own.n IS NOT NULL AS has_data, round(coalesce(sc, 0.0), 2) AS score,
  CAST(coalesce(n, 0) AS BIGINT) AS uses, CAST(coalesce(first, 0) AS BIGINT) AS wins,
  round(coalesce((first + 2 * second + 3 * third) / CAST(nullif(first + second + third, 0) AS DOUBLE), 0.0), 2) AS avg_place,
  coalesce(first / CAST(n AS DOUBLE), 0.0) AS rate, {_KNOWN} AS known, {_RATES} AS rates, {_THEORY} AS parts,
  CASE WHEN early > 0 THEN (late - early) / early * 10 ELSE 0.0 END AS trend, (SELECT max(raw_score) FROM mt) AS top_score,
  EXISTS (SELECT 1 FROM mt WHERE mt.blade = dk.blade AND mt.ratchet = dk.ratchet AND mt.bit = dk.bit) AS is_meta_pick
  FROM dk LEFT JOIN own ON own.blade = dk.blade AND own.ratchet = dk.ratchet AND own.bit = dk.bit
  LEFT JOIN r_blade ON r_blade.blade = dk.blade LEFT JOIN r_ratchet ON r_ratchet.ratchet = dk.ratchet
  LEFT JOIN r_bit ON r_bit.bit = dk.bit LEFT JOIN tr ON tr.combo = concat_ws(' ', dk.blade, dk.ratchet, dk.bit)),
t AS (SELECT *, coalesce(rates / nullif(known, 0), 0.25) AS mean_rate, coalesce(parts / nullif(known, 0), 0.0) AS theory FROM j),
rc AS (SELECT deck_id, blade, ratchet, bit, has_data, score, uses, wins, avg_place, round(rate * 100, 4) AS win_rate,
  round(CASE WHEN has_data THEN least(coalesce(score / nullif(top_score, 0) * 100, 50.0), 100.0) ELSE least(theory * 0.5, 50.0) END, 4) AS meta_score,
  round(CASE WHEN has_data THEN least(CASE WHEN avg_place > 0 THEN greatest(0.0, (4 - avg_place) / 3) * 100 ELSE 0.0 END * 0.8
        + least(uses / 10.0, 1.0) * 20, 100.0) ELSE 0.0 END, 4) AS consistency_score,
  round(CASE WHEN has_data THEN least(rate * 60 + least(wins * 10, 50), 100.0) ELSE theory * 0.6 END, 4) AS upside_score,
  round(CASE WHEN has_data THEN least(greatest((CASE WHEN mean_rate > 0 THEN rate / mean_rate ELSE 1.0 END - 0.5) * 100, 0.0), 100.0)
        WHEN known = 3 THEN theory * 0.7 ELSE 0.0 END, 4) AS synergy_score,
  round(CASE WHEN has_data THEN least(greatest(0.0, 1 - uses / 20.0) * 50 + CASE WHEN rate > 0.3 THEN (rate - 0.3) * 100 ELSE 0.0 END, 100.0)
        WHEN known = 3 THEN 40.0 ELSE 0.0 END, 4) AS surprise_score,
  round(CASE WHEN has_data THEN 50 + greatest(-50.0, least(50.0, trend * 10)) ELSE 50.0 END, 4) AS trend_score, is_meta_pick,
  has_data AND uses BETWEEN 2 AND 10 AND rate >= 0.3 AS is_hidden_gem, has_data AND trend > 2 AS is_rising FROM t),
ro AS (SELECT *, round(meta_score * 0.30 + consistency_score * 0.20 + upside_score * 0.20 + synergy_score * 0.15
       + surprise_score * 0.05 + trend_score * 0.10, 6) AS overall FROM rc)
"""
_STRENGTHS = ", ".join(
    f"CASE WHEN {when} THEN '{name}' END"
    for when, name in (
        ("meta_coverage >= 70", "meta coverage"), ("consistency >= 70", "consistency"), ("upside >= 70", "high ceiling"),
        ("diversity >= 80", "diversity"), ("surprise >= 60", "upset potential"), ("rising", "rising picks"),
        ("strong >= 2", "strong core"),
    )
)
_WEAKNESSES = ", ".join(
    f"CASE WHEN {when} THEN '{name}' END"
    for when, name in (
        ("meta_coverage < 40", "meta coverage"), ("consistency < 40", "inconsistent"), ("upside < 40", "low ceiling"),
        ("diversity < 50", "predictable"), ("NOT has_any", "untested"), ("weak >= 2", "weak core"),
    )
)
_ADVICE = ", ".join(
    f"CASE WHEN {when} THEN '{name}' END"
    for when, name in (
        ("meta_coverage < 50 AND NOT leader", "add the leading blade"), ("worst IN ('D', 'F', '?')", "replace the weakest combo"),
        ("diversity < 50 AND blades < 3", "vary the blades"), ("consistency < 50 AND upside > 60", "add steady combos"),
        ("surprise < 30 AND meta_coverage > 70", "add a surprise"),
    )
)


def _deck_tier(limits: tuple[int, ...]) -> str:
    return "CASE " + " ".join(f"WHEN overall >= {x} THEN '{n}'" for x, n in zip(limits, "SABCD", strict=True)) + " ELSE 'F' END"


ORACLE_SQL["rate_combo"] = DECKS + f"SELECT *, CASE WHEN has_data THEN {_deck_tier((85, 70, 55, 40, 25))} ELSE '?' END AS tier FROM ro"
ORACLE_SQL["rate_deck"] = DECKS + f""", mo AS (SELECT *, row_number() OVER (ORDER BY raw_score DESC, {COMBO}) AS pos FROM mt),
tb AS (SELECT DISTINCT blade FROM mo WHERE pos <= 10),
rt AS (SELECT *, CASE WHEN has_data THEN {_deck_tier((85, 70, 55, 40, 25))} ELSE '?' END AS ctier FROM ro),
dd AS (SELECT deck_id, round(sum(overall) / 3, 6) AS overall,
  round((SELECT count(*) FROM tb WHERE tb.blade IN (SELECT blade FROM ro q WHERE q.deck_id = rt.deck_id))
        / CAST(greatest((SELECT least(count(*), 3) FROM tb), 1) AS DOUBLE) * 50 + {count('is_meta_pick')} / 3.0 * 50, 4) AS meta_coverage,
  round(count(DISTINCT blade) / 3.0 * 40 + count(DISTINCT ratchet) / 3.0 * 30 + count(DISTINCT bit) / 3.0 * 30, 4) AS diversity,
  round(sum(consistency_score) / 3, 4) AS consistency, round(max(upside_score) * 0.6 + sum(upside_score) / 3 * 0.4, 4) AS upside,
  round(least(sum(surprise_score) / 3 + {count('is_hidden_gem')} * 15, 100.0), 4) AS surprise, bool_or(has_data) AS has_any,
  bool_or(is_rising) AS rising, {count("ctier IN ('S', 'A')")} AS strong, {count("ctier IN ('D', 'F', '?')")} AS weak, count(DISTINCT blade) AS blades,
  coalesce(bool_or(blade = (SELECT blade FROM mo WHERE pos = 1)), true) AS leader,
  (list_sort(list((round(meta_score + consistency_score, 4), ctier))))[1][2] AS worst FROM rt GROUP BY deck_id)
SELECT deck_id, overall, {_deck_tier((80, 65, 50, 35, 20))} AS tier, meta_coverage, diversity, consistency, upside, surprise,
coalesce(nullif(concat_ws(', ', {_STRENGTHS}), ''), CASE WHEN has_any THEN 'tested' ELSE 'new combinations' END) AS strengths,
concat_ws(', ', {_WEAKNESSES}) AS weaknesses, concat_ws(', ', {_ADVICE}) AS advice FROM dd"""
ORACLE_SQL["gems_underused_as_of"] = (
    ORACLE_SQL["gems_underused"].replace(WITH, as_of("1998-06-30", "ASIA"), 1).replace("ru <= 5000", "ru <= 5")
)
