"""DuckDB SQL that says the same as the queries of queries.py, built from shared fragments."""

from __future__ import annotations

from playtide.sources.plays import EVENTS_SQL, PLAYS_SQL, TOP_ALBUMS_SQL

WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NWS = WS[1:-1]


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '{WS}+', ' ', 'g'), ' ')"


def apostrophes(x: str) -> str:
    return f"regexp_replace({x}, '[‘’ʼ`´]', '''', 'g')"


def norm(x: str) -> str:
    return squeeze(rf"lower(regexp_replace(strip_accents({apostrophes(x)}), '[^\p{{L}}\p{{N}}{NWS}'']', ' ', 'g'))")


def norm_title(x: str) -> str:
    return squeeze(rf"lower(regexp_replace({apostrophes(f'nfc_normalize({x})')}, '[^\p{{L}}\p{{N}}\p{{M}}{NWS}'']', ' ', 'g'))")


def track_identity(x: str) -> str:
    return rf"regexp_replace({squeeze(f'lower({apostrophes(f"nfc_normalize({x})")})')}, '{WS}*([^\p{{L}}\p{{N}}\p{{M}}{NWS}''])' || '{WS}*', '\1', 'g')"


def norm_release(x: str) -> str:
    return squeeze(rf"regexp_replace(strip_accents(lower({x})), '[^\p{{L}}\p{{N}}{NWS}]', ' ', 'g')")


def base_title(x: str) -> str:
    return rf"trim(regexp_replace({x}, '(?i)(\s*[(\[]\s*(?:feat\.?|ft\.?|featuring|with|w/)\s+[^)\]]*[)\]]\s*)+$', ''))"


QUAL = "(?:era|sessions?|sesh)"
STRONG = r"\b(?:unreleased|unrelased|og\s*files?|ref(?:erence)?\s*tracks?|cdq)\b"
WEAK = r"\b(?:leak(?:s|ed)?|snippets?|outtakes?|leftovers?)\b"

CELLS = rf"""WITH plays AS ({PLAYS_SQL}),
c0 AS (SELECT "user", artist, album, track, count(*) AS plays, min(uts) AS first_uts, max(uts) AS last_uts, min(seq) AS seq FROM plays GROUP BY ALL),
c1 AS (SELECT *, {norm('artist')} AS artist_key, {norm('album')} AS album_key, {norm('track')} AS track_key, {norm_title('track')} AS track_title, {track_identity('track')} AS track_id,
  {base_title('track')} AS track_base, {track_identity(base_title('track'))} AS base_id,
  regexp_matches(album, '(?i){STRONG}') OR regexp_matches(album, '(?i)[(\[](?:[^)\]]*\s)?{QUAL}\s*[)\]]') AS era_explicit FROM c0),
c2 AS (SELECT *, NOT era_explicit AND regexp_matches(album, '(?i){WEAK}') AS era_weak, NOT era_explicit AND regexp_matches(trim(album), '(?i)\S\s+{QUAL}$') AS era_ambiguous,
  coalesce(nullif(trim(regexp_replace(regexp_extract(album, '(?i)[(\[]([^)\]]*?)\s+{QUAL}\s*[)\]]', 1), '\s+', ' ', 'g')), ''),
    nullif(trim(regexp_replace(regexp_replace(regexp_extract(album, '(?i)^(.*)[(\[]\s*{QUAL}\s*[)\]]\s*$', 1), '(?i){STRONG}', ' '), '\s+', ' ', 'g')), ''),
    nullif(trim(regexp_extract(trim(album), '(?i)^(.*\S)\s+{QUAL}$', 1)), '')) AS era_name FROM c1),
taggers AS (SELECT DISTINCT "user" AS tu, artist_key AS tk FROM c2 WHERE era_explicit),
cells AS (SELECT c2.*, era_explicit OR ((era_weak OR era_ambiguous) AND tk IS NOT NULL) AS is_era, (era_explicit OR era_weak) AND era_name IS NULL AS undifferentiated
  FROM c2 LEFT JOIN taggers ON tu = "user" AND tk = artist_key),
rest AS (SELECT * FROM cells WHERE NOT is_era), era AS (SELECT * FROM cells WHERE is_era)
"""

EVENTS = f"WITH plays AS ({EVENTS_SQL})\n"

KIND = rf"""CASE WHEN shown = '(no album)' THEN 'missing' WHEN {norm_title('shown')} = {norm_title('track')} THEN 'single (album titled after the track)'
  WHEN regexp_matches(shown, '(?i)\s*[-–]\s*(single|ep)$') THEN 'single or EP'
  WHEN regexp_matches(shown, '(?i)greatest\s+hits|best\s+of|\bhits\b|anthology|collection|compilation|essential|retrospective') THEN 'compilation'
  WHEN regexp_matches(shown, '(?i)\s*[(\[\-]\s*(deluxe|expanded|remaster(ed)?|anniversary|bonus|special|complete|extended|super\s*deluxe|japanese|uk|us|explicit|clean|alternate)\b[^)\]]*[)\]]?\s*$') THEN 'edition variant'
  ELSE 'album' END"""

SPLITS = CELLS + rf""", m0 AS (SELECT "user", artist_key, track_id, CASE WHEN album = '' THEN '(no album)' ELSE album END AS shown, CASE WHEN album = '' THEN 'no album' ELSE album_key END AS shown_key,
  sum(plays) AS plays, min(first_uts) AS first, max(last_uts) AS last, min(seq) AS seq, arg_min(artist, seq) AS artist, arg_min(track, seq) AS track FROM rest GROUP BY ALL),
g0 AS (SELECT "user", artist_key, track_id, arg_min(artist, seq) AS artist, arg_min(track, seq) AS track, CAST(sum(plays) AS BIGINT) AS total, min(seq) AS seq, count(*) AS n,
  string_agg(shown || ':' || plays, '|' ORDER BY plays DESC, seq) AS members FROM m0 GROUP BY ALL HAVING count(*) >= 2 AND sum(plays) >= 2),
m1 AS (SELECT m0.* EXCLUDE (artist, track), g0.artist, g0.track, g0.total, g0.n, row_number() OVER (PARTITION BY "user", artist_key, track_id ORDER BY m0.plays DESC, m0.seq) AS i,
  row_number() OVER (PARTITION BY "user", artist_key, track_id ORDER BY m0.first, m0.plays DESC, m0.seq) AS j FROM m0 JOIN g0 USING ("user", artist_key, track_id)),
ids AS (SELECT "user", {norm('artist')} AS artist_key, {norm('album')} AS album_key, list(DISTINCT album_mbid) AS ids FROM plays p WHERE album <> '' AND album_mbid <> ''
  AND EXISTS (SELECT 1 FROM rest r WHERE r."user" = p."user" AND r.artist = p.artist AND r.album = p.album AND r.track = p.track) GROUP BY ALL),
k AS (SELECT m1.*, {KIND} AS kind FROM m1),
d0 AS (SELECT "user", artist_key, track_id, any_value(artist) AS artist, any_value(track) AS track, any_value(total) AS total, any_value(n) AS n,
  max(CASE WHEN i = 1 THEN shown_key END) AS key0, max(CASE WHEN i = 2 THEN shown_key END) AS key1, arg_max(plays, i) AS least, bool_or(i <= 2 AND kind IN ('single or EP', 'edition variant', 'compilation', 'missing')) AS singleish,
  max(CASE WHEN j = 1 THEN shown END) AS earlier, max(CASE WHEN j = 2 THEN shown END) AS later, max(CASE WHEN j = 1 THEN last END) AS e_last, max(CASE WHEN j = 2 THEN first END) AS l_first FROM k GROUP BY ALL),
d1 AS (SELECT d0.*, a.ids AS ids0, b.ids AS ids1, n = 2 AND e_last <= l_first AS apart FROM d0 LEFT JOIN ids a ON a."user" = d0."user" AND a.artist_key = d0.artist_key AND a.album_key = key0
  LEFT JOIN ids b ON b."user" = d0."user" AND b.artist_key = d0.artist_key AND b.album_key = key1),
d2 AS (SELECT *, CASE WHEN ids0 IS NULL OR ids1 IS NULL THEN 'unknown' WHEN list_has_any(ids0, ids1) THEN 'same' ELSE 'different' END AS verdict,
  regexp_full_match({norm_title('track')}, '(?:intro|outro|interlude|skit|prelude|epilogue|intermission|reprise|untitled|hidden track|bonus track|instrumental)\s*[0-9]*') AS structural,
  apart AND {norm_title('earlier')} <> '' AND {norm_title('later')} <> '' AND (contains({norm_title('earlier')}, {norm_title('track')}) OR regexp_matches(earlier, '(?i)\s[-–]\s(single|ep)$')
    OR contains({norm_title('earlier')}, {norm_title('later')}) OR contains({norm_title('later')}, {norm_title('earlier')})) AS migration FROM d1),
decided AS (SELECT *, CASE WHEN verdict = 'same' THEN 'proven' WHEN verdict = 'different' THEN 'disproven' WHEN structural THEN 'structural' WHEN least <= 1 AND total <= 4 THEN 'stray'
  WHEN NOT migration AND NOT singleish THEN 'plain-albums' WHEN migration THEN 'migration' ELSE 'candidate' END AS reason FROM d2)
"""
CLASS = "CASE reason WHEN 'proven' THEN 'error' WHEN 'migration' THEN 'split' WHEN 'candidate' THEN 'split' ELSE 'review' END"
CONFIDENCE = "CAST(CASE reason WHEN 'proven' THEN 0.97 WHEN 'disproven' THEN 0.15 WHEN 'structural' THEN 0.25 WHEN 'stray' THEN 0.3 WHEN 'plain-albums' THEN 0.2 WHEN 'migration' THEN 0.9 ELSE 0.7 END AS DOUBLE)"

MONTH = "strftime(make_timestamp(uts * 1000000), '%Y-%m')"
DUPES = EVENTS + """, o AS (SELECT *, lag(uts) OVER w AS b_uts, lag(artist) OVER w AS b_artist, lag(track) OVER w AS b_track FROM plays WINDOW w AS (PARTITION BY "user" ORDER BY uts, seq)),
dupes AS (SELECT "user", seq, uts, artist, track, b_uts AS previous_uts FROM o WHERE uts - b_uts <= 30 AND artist = b_artist AND track = b_track)
"""

TOP = f"""WITH top AS ({TOP_ALBUMS_SQL}), t AS (SELECT *, {norm('name')} AS title_key, {norm('artist')} AS artist_key FROM top),
pairs AS (SELECT a."user", a.name AS a_name, b.name AS b_name, a.artist AS a_artist, b.artist AS b_artist, a.playcount AS a_plays, b.playcount AS b_plays, a.ord AS a_ord, b.ord AS b_ord,
  CASE WHEN a.mbid <> '' AND a.mbid = b.mbid THEN 'release' WHEN a.artist_key IN ('various artists', 'various', 'va', 'verschillende artiesten') OR b.artist_key IN ('various artists', 'various', 'va', 'verschillende artiesten') THEN 'various'
    WHEN contains(' ' || a.artist_key || ' ', ' ' || b.artist_key || ' ') OR contains(' ' || b.artist_key || ' ', ' ' || a.artist_key || ' ') THEN 'name' END AS evidence
  FROM t a JOIN t b ON a."user" = b."user" AND a.title_key = b.title_key AND a.ord < b.ord AND a.artist_key <> b.artist_key AND a.playcount + b.playcount >= 4)
"""

ARTISTS = CELLS + """, counts AS (SELECT "user", artist, any_value(artist_key) AS artist_key, CAST(sum(plays) AS BIGINT) AS plays, min(seq) AS seq FROM rest GROUP BY ALL),
with_ids AS (SELECT DISTINCT r."user", r.artist_key FROM plays p JOIN rest r ON r."user" = p."user" AND r.artist = p.artist AND r.album = p.album AND r.track = p.track WHERE p.artist_mbid <> ''),
named AS (SELECT *, CASE WHEN regexp_matches(artist, '(?i)\\s+(feat\\.?|ft\\.?|featuring|w/)\\s+') THEN 'strong' WHEN regexp_matches(artist, '(?i)\\s+(with|\\bx\\b)\\s+') THEN 'weak'
  WHEN regexp_matches(artist, '[&,+]') THEN 'join' END AS kind FROM counts)
"""

PLAN = SPLITS + """, jobs AS (SELECT "user", artist, track, total AS plays, 0 AS t, -total AS p, g0.seq AS s, 'split' AS kind FROM g0
  UNION ALL SELECT "user", arg_min(artist, seq), arg_min(track, seq), sum(plays), 1, 0, min(seq), 'missing' FROM rest WHERE album = '' GROUP BY "user", artist_key, track_id
  UNION ALL SELECT "user", artist, track, sum(plays), 2, 0, min(seq), 'era' FROM era GROUP BY "user", artist, track),
one AS (SELECT "user", arg_min(artist, (t, p, s)) AS artist, arg_min(track, (t, p, s)) AS track, CAST(sum(plays) AS BIGINT) AS plays, arg_min(kind, (t, p, s)) AS kind, min((t, p, s)) AS first_at FROM jobs GROUP BY "user", lower(artist), lower(track)),
mb AS (SELECT "user", """ + norm("artist") + """ AS mk, arg_min(artist_mbid, seq) AS artist_mbid FROM plays WHERE artist_mbid <> '' GROUP BY ALL),
plan AS (SELECT one."user", artist, """ + norm("artist") + """ AS artist_key, track, plays, kind, artist_mbid, row_number() OVER (PARTITION BY one."user" ORDER BY plays DESC, first_at) AS place FROM one LEFT JOIN mb ON mb."user" = one."user" AND mk = """ + norm("artist") + """),
strategy AS (SELECT "user", artist_key, arg_min(artist, place) AS artist, count(*) AS jobs, CAST(sum(plays) AS BIGINT) AS plays, arg_min(artist_mbid, place) AS mbid FROM plan GROUP BY ALL)
"""

CATALOGUE = f"""WITH p AS (SELECT *, {norm('p_brand')} AS artist_key FROM part),
rel AS (SELECT artist_key, p_brand || '/' || p_type || '/' || (p_partkey % 3) AS rg_id, arg_min(p_type || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' (Deluxe Edition)' ELSE ' - Remastered' END, p_partkey) AS title,
  arg_min(CASE WHEN p_partkey % 5 = 0 THEN '' ELSE CAST(1960 + p_partkey % 60 AS VARCHAR) END, p_partkey) AS first_release FROM p GROUP BY ALL),
tr AS (SELECT artist_key, CASE WHEN p_partkey % 4 = 0 THEN p_name || ' (feat. Guest)' WHEN p_partkey % 7 = 0 THEN replace(p_name, 'e', 'é') ELSE p_name END AS title, p_brand || '/' || p_type || '/' || (p_partkey % 3) AS rg_id, p_partkey AS ord FROM p),
idx AS (SELECT artist_key, title_key, rg_id, min(ord) AS ord FROM (SELECT artist_key, rg_id, ord, unnest(list_distinct([{norm_title('title')}, {norm_title(base_title('title'))}])) AS title_key FROM tr) WHERE title_key <> '' GROUP BY ALL),
listed AS (SELECT artist_key, title_key, min(ord) AS ord, {norm('title_key')} AS folded FROM idx GROUP BY ALL),
want AS (SELECT DISTINCT artist_key, track, {norm_title('track')} AS exact, {norm_title(base_title('track'))} AS base, {norm('track')} AS folded FROM (SELECT artist_key, CASE WHEN p_size % 6 = 0 THEN p_name || ' [with Guest]' WHEN p_size % 6 = 1 THEN replace(p_name, 'e', 'ê') ELSE p_name END AS track FROM p)),
hit AS (SELECT artist_key, track, 0 AS t, exact AS title_key FROM want WHERE EXISTS (SELECT 1 FROM listed l WHERE l.artist_key = want.artist_key AND l.title_key = exact)
  UNION ALL SELECT artist_key, track, 1, base FROM want WHERE base <> '' AND base <> exact AND EXISTS (SELECT 1 FROM listed l WHERE l.artist_key = want.artist_key AND l.title_key = base)
  UNION ALL SELECT w.artist_key, track, 2, (SELECT arg_min(l.title_key, (l.ord, l.title_key)) FROM listed l WHERE l.artist_key = w.artist_key AND l.folded = w.folded) FROM want w WHERE EXISTS (SELECT 1 FROM listed l WHERE l.artist_key = w.artist_key AND l.folded = w.folded)),
tier AS (SELECT artist_key, track, min(t) AS t, arg_min(title_key, t) AS title_key FROM hit GROUP BY ALL)
"""

SCORE = SPLITS + f""", issues AS (SELECT "user", 'D4' AS detector, {CLASS} AS class, total AS plays_affected FROM decided
  UNION ALL SELECT "user", 'D5', 'error', CAST(sum(plays) AS BIGINT) FROM rest WHERE album = '' GROUP BY ALL
  UNION ALL SELECT "user", 'D11', 'error', CAST(sum(plays) AS BIGINT) FROM rest WHERE artist_key IN ('various artists', 'va', 'various') GROUP BY ALL
  UNION ALL SELECT "user", 'D12', 'anomaly', CAST(sum(n) AS BIGINT) FROM (SELECT "user", uts // 3600 AS h, count(*) AS n FROM plays GROUP BY ALL HAVING count(*) > 20) GROUP BY ALL)
"""

HOURS = """SELECT "user", CAST(floor(uts / 3600) AS BIGINT) AS hour, count(*) AS plays FROM plays GROUP BY ALL HAVING count(*) > """

SQL: dict[str, str] = {
    "norm_title": f"SELECT doc_id, md5({norm_title('text')}) AS key FROM documents",
    "norm_loose": f"SELECT doc_id, md5({norm('text')}) AS key FROM documents",
    "norm_release": f"SELECT doc_id, md5({norm_release('text')}) AS key FROM documents",
    "track_identity": f"SELECT doc_id, md5({track_identity('text')}) AS key FROM documents",
    "base_title": CELLS + 'SELECT DISTINCT track, track_base AS base, base_id AS identity FROM cells',
    "era_flags": CELLS + "SELECT DISTINCT album, era_explicit, era_weak, era_ambiguous, era_name, undifferentiated FROM cells",
    "era_partition": CELLS + 'SELECT "user", artist, album, track, plays, is_era FROM cells',
    "era_overview": CELLS + """, s AS (SELECT "user", sum(plays) AS all_plays, sum(plays) FILTER (WHERE is_era) AS plays FROM cells GROUP BY ALL),
a AS (SELECT "user", count(DISTINCT (artist, album)) AS album_strings, count(DISTINCT artist) FILTER (WHERE era_name IS NOT NULL) AS artists, count(DISTINCT (artist, era_name)) FILTER (WHERE era_name IS NOT NULL) AS distinct_eras FROM era GROUP BY ALL)
SELECT "user", CAST(plays AS BIGINT) AS plays, round(100 * plays / all_plays, 2) AS share_of_all_plays, album_strings, artists, distinct_eras FROM s JOIN a USING ("user")""",
    "weak_candidates": CELLS + """, c AS (SELECT "user", arg_min(artist, seq) AS artist, arg_min(album, seq) AS album, CAST(sum(plays) AS BIGINT) AS plays, min(seq) AS seq FROM cells WHERE album <> '' AND NOT era_explicit AND (era_weak OR era_ambiguous) GROUP BY "user", artist_key, album_key)
SELECT * EXCLUDE (seq) FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY plays DESC, seq) AS rank FROM c) WHERE rank <= 40""",
    "d4_groups": SPLITS + 'SELECT "user", artist, track, total AS plays_affected, members FROM g0',
    "d4_members": SPLITS + 'SELECT "user", artist, track, shown AS album, CAST(plays AS BIGINT) AS plays, first, last, kind AS looks_like FROM k',
    "d4_decision": SPLITS + f'SELECT "user", artist, track, total AS plays_affected, verdict, reason, {CLASS} AS class, {CONFIDENCE} AS confidence FROM decided',
    "mbid_verdicts": SPLITS + 'SELECT verdict, count(*) AS groups, CAST(sum(total) AS BIGINT) AS plays FROM decided GROUP BY ALL',
    "d5_missing": CELLS + """SELECT "user", arg_min(artist, seq) AS artist, arg_min(track, seq) AS track, CAST(sum(plays) AS BIGINT) AS plays, min(first_uts) AS first, max(last_uts) AS last FROM rest WHERE album = '' GROUP BY "user", artist_key, track_id""",
    "d5_months": f"""WITH plays AS ({PLAYS_SQL}) SELECT "user", {MONTH} AS month, count(*) AS plays FROM plays WHERE album = '' GROUP BY ALL""",
    "d6_dupes": DUPES + "SELECT * FROM dupes",
    "d6_systemic": DUPES + f""", t AS (SELECT "user", {MONTH} AS month, count(*) AS total FROM plays GROUP BY ALL), d AS (SELECT "user", {MONTH} AS month, count(*) AS dupes FROM dupes GROUP BY ALL)
SELECT "user", month, dupes, total FROM d JOIN t USING ("user", month) WHERE total >= 50 AND dupes / total > 0.001""",
    "d7_casing": CELLS + """SELECT "user", lower(artist) AS name, string_agg(artist || ':' || plays, '|' ORDER BY artist) AS members, CAST(sum(plays) AS BIGINT) AS plays_affected FROM (SELECT "user", artist, sum(plays) AS plays FROM rest GROUP BY ALL) GROUP BY ALL HAVING count(*) > 1""",
    "d8_titles": CELLS + f""", v AS (SELECT "user", artist_key, base_id, track, any_value(track_id) AS track_id, sum(plays) AS plays, min(seq) AS seq, arg_min(artist, seq) AS artist,
  regexp_extract(track, '(?i)\\(feat\\. ([^)]*)\\)$', 1) AS credit FROM rest GROUP BY "user", artist_key, base_id, track),
ids AS (SELECT r."user", r.artist_key, r.track_id, list(DISTINCT p.track_mbid) AS ids FROM plays p JOIN rest r ON r."user" = p."user" AND r.artist = p.artist AND r.album = p.album AND r.track = p.track WHERE p.track_mbid <> '' GROUP BY ALL),
o AS (SELECT v.*, ids.ids, row_number() OVER (PARTITION BY v."user", v.artist_key, base_id ORDER BY plays DESC, seq) AS i FROM v LEFT JOIN ids ON ids."user" = v."user" AND ids.artist_key = v.artist_key AND ids.track_id = v.track_id),
g AS (SELECT "user", artist_key, base_id, arg_min(artist, seq) AS artist, arg_min(track, i) AS track, count(*) AS n, sum(plays) AS total, sum(plays) FILTER (WHERE i > 1) AS strays, count(DISTINCT nullif(credit, '')) > 1 AS clash, sum(plays) FILTER (WHERE credit = '') AS bare,
  max(ids) FILTER (WHERE i = 1) AS a, max(ids) FILTER (WHERE i = 2) AS b FROM o GROUP BY ALL HAVING count(*) >= 2),
w AS (SELECT *, CASE WHEN a IS NULL OR b IS NULL THEN 'unknown' WHEN list_has_any(a, b) THEN 'same' ELSE 'different' END AS verdict FROM g),
x AS (SELECT *, CASE verdict WHEN 'same' THEN false WHEN 'different' THEN true ELSE clash END AS conflict FROM w)
SELECT "user", artist, track, verdict, CASE WHEN conflict THEN 'conflict' WHEN verdict = 'same' THEN 'proven' WHEN strays <= 2 AND strays / total < 0.15 THEN 'stray' ELSE 'variants' END AS kind,
  CAST(CASE WHEN conflict THEN bare ELSE total END AS BIGINT) AS plays_affected FROM x WHERE NOT conflict OR bare > 0""",
    "d8_joint": ARTISTS + f""", j AS (SELECT n.*, trim(split_part(artist, '&', 1)) AS a, trim(split_part(artist, '&', 2)) AS b FROM named n WHERE kind = 'join' AND len(regexp_split_to_array(artist, '[&,+]')) = 2
  AND NOT EXISTS (SELECT 1 FROM with_ids w WHERE w."user" = n."user" AND w.artist_key = n.artist_key)),
al AS (SELECT "user", artist_key, count(DISTINCT album_key) AS albums FROM rest WHERE album <> '' GROUP BY ALL),
loose AS (SELECT "user", artist_key, arg_min(plays, seq) AS plays FROM counts GROUP BY ALL),
q AS (SELECT j."user", j.artist, j.artist_key, j.plays, a, b, coalesce(ca.plays, la.plays, 0) AS a_plays, coalesce(cb.plays, lb.plays, 0) AS b_plays FROM j
  LEFT JOIN counts ca ON ca."user" = j."user" AND ca.artist = a LEFT JOIN counts cb ON cb."user" = j."user" AND cb.artist = b
  LEFT JOIN loose la ON la."user" = j."user" AND la.artist_key = {norm('a')} LEFT JOIN loose lb ON lb."user" = j."user" AND lb.artist_key = {norm('b')})
SELECT q."user", artist, q.plays, a, a_plays, b, b_plays, coalesce(albums, 0) AS albums FROM q LEFT JOIN al ON al."user" = q."user" AND al.artist_key = q.artist_key WHERE a_plays >= 5 AND b_plays >= 5""",
    "d8_field": ARTISTS + f""", f AS (SELECT *, trim(regexp_extract(artist, '(?i)^(.*?)\\s+(feat\\.?|ft\\.?|featuring|w/|with|\\bx\\b)\\s+', 1)) AS head FROM named n WHERE kind IN ('strong', 'weak') AND NOT EXISTS (SELECT 1 FROM with_ids w WHERE w."user" = n."user" AND w.artist_key = n.artist_key))
SELECT f."user", f.artist, f.kind, head, f.plays, coalesce(c.plays, 0) AS head_plays FROM f LEFT JOIN counts c ON c."user" = f."user" AND c.artist = head
WHERE {norm('head')} <> f.artist_key AND EXISTS (SELECT 1 FROM named n WHERE n."user" = f."user" AND coalesce(n.kind, 'join') = 'join' AND n.artist_key = {norm('head')})""",
    "d1_exact": CELLS + """, c AS (SELECT "user", artist, any_value(regexp_replace(artist_key, '^the ', '')) AS fold, lower(artist) AS low, CAST(sum(plays) AS BIGINT) AS plays, min(seq) AS seq FROM rest GROUP BY "user", artist),
g AS (SELECT "user", fold, arg_max(artist, (plays, -seq)) AS target, arg_max(low, (plays, -seq)) AS target_low, count(*) AS n, count(DISTINCT low) AS spellings FROM c GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT low) > 1),
k AS (SELECT c.*, target FROM c JOIN g USING ("user", fold) WHERE artist = target OR low <> target_low)
SELECT "user", fold, any_value(target) AS target, CAST(sum(plays) AS BIGINT) AS plays_affected, string_agg(artist || ':' || plays, '|' ORDER BY plays DESC, seq) AS members FROM k GROUP BY "user", fold HAVING count(*) >= 2""",
    "d11_various": CELLS + """SELECT "user", album, CAST(sum(plays) AS BIGINT) AS plays FROM rest WHERE artist_key IN ('various artists', 'va', 'various') GROUP BY ALL""",
    "d12_bursts": EVENTS + HOURS + "3",
    "d12_future": EVENTS + 'SELECT "user", seq, uts, track FROM plays WHERE uts > epoch(TIMESTAMP \'2024-01-15 00:00:00\') + 3600',
    "d14a_formats": CELLS + """, a AS (SELECT "user", artist, album, any_value(album_key) AS album_key, CAST(sum(plays) AS BIGINT) AS plays, min(seq) AS seq FROM era GROUP BY "user", artist, album)
SELECT "user", artist, album_key, string_agg(album || ':' || plays, '|' ORDER BY plays DESC, seq) AS members, CAST(sum(plays) AS BIGINT) AS plays_affected FROM a GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT lower(album)) > 1""",
    "d14c_multi_era": CELLS + """SELECT "user", artist, arg_min(track, seq) AS track, count(DISTINCT era_name) AS eras, list_aggregate(list_sort(list(DISTINCT era_name)), 'string_agg', '|') AS names, CAST(sum(plays) AS BIGINT) AS plays_affected,
  CAST(CASE WHEN bool_or(regexp_matches(era_name, '(?i)\\bv[0-9]+\\b')) THEN 0.3 ELSE 0.45 END AS DOUBLE) AS confidence FROM era WHERE era_name IS NOT NULL GROUP BY "user", artist, track_id HAVING count(DISTINCT era_name) >= 2""",
    "d14f_buckets": CELLS + """, b AS (SELECT "user", arg_min(artist, seq) AS artist, arg_min(album, seq) AS album, CAST(sum(plays) AS BIGINT) AS plays, count(DISTINCT track_title) AS tracks FROM era WHERE undifferentiated GROUP BY "user", artist_key, album_key HAVING count(DISTINCT track_title) >= 3),
r AS (SELECT "user", artist, album, sum(plays) AS plays FROM rest WHERE album <> '' GROUP BY ALL)
SELECT b.*, (SELECT count(*) FROM r WHERE r."user" = b."user" AND r.plays > b.plays) + 1 AS chart_rank FROM b""",
    "d15_album_artist": TOP + """SELECT "user", evidence, CASE WHEN a_plays >= b_plays THEN a_name ELSE b_name END AS album, CASE WHEN a_plays >= b_plays THEN a_artist ELSE b_artist END AS artist, CASE WHEN a_plays >= b_plays THEN b_artist ELSE a_artist END AS other,
  a_plays + b_plays AS plays_affected, CAST(CASE evidence WHEN 'release' THEN 0.95 WHEN 'various' THEN 0.85 ELSE 0.8 END AS DOUBLE) AS confidence FROM pairs WHERE evidence IS NOT NULL""",
    "d16_candidates": CELLS + f"""SELECT "user", arg_min(artist, seq) AS artist, arg_min(track, seq) AS track, arg_min(album, seq) AS album, CAST(sum(plays) AS BIGINT) AS plays FROM rest
WHERE artist <> '' AND track <> '' AND album <> '' AND (regexp_matches(trim(album), '(?i)[-–—(\\[]\\s*(single|ep)\\s*[)\\]]?$') OR (album_key <> '' AND album_key IN (track_key, {norm('track_base')}))) GROUP BY "user", artist_key, track_id, album_key""",
    "album_chart": CELLS + """SELECT "user", artist, album, CAST(sum(plays) AS BIGINT) AS plays FROM rest WHERE album <> '' GROUP BY ALL""",
    "chart_rank": CELLS + """, r AS (SELECT "user", artist, album, CAST(sum(plays) AS BIGINT) AS plays, min(seq) AS seq FROM rest WHERE album <> '' GROUP BY ALL)
SELECT * EXCLUDE (seq) FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY plays DESC, seq) AS rank FROM r) WHERE rank <= 200""",
    "top_albums_per_artist": CELLS + """, r AS (SELECT "user", any_value(artist_key) AS artist_key, artist, album, CAST(sum(plays) AS BIGINT) AS plays, min(seq) AS seq FROM rest WHERE album <> '' GROUP BY "user", artist, album)
SELECT * EXCLUDE (seq) FROM (SELECT *, row_number() OVER (PARTITION BY "user", artist_key ORDER BY plays DESC, seq) AS place FROM r) WHERE place <= 3""",
    "resolution_plan": PLAN + 'SELECT "user", artist, track, plays, kind, artist_mbid FROM plan',
    "by_artist": PLAN + 'SELECT "user", artist_key, artist, jobs, plays, mbid FROM strategy',
    "strategy_split": PLAN + 'SELECT "user", artist_key, jobs, jobs > CASE WHEN mbid IS NULL THEN 2 ELSE 1 END AS catalogue FROM strategy',
    "plan_estimates": PLAN + """, s AS (SELECT *, jobs > CASE WHEN mbid IS NULL THEN 2 ELSE 1 END AS catalogue FROM strategy)
SELECT "user", CAST(sum(CAST(catalogue AS INT)) AS BIGINT) AS artists, CAST(sum(CASE WHEN catalogue THEN jobs ELSE 0 END) AS BIGINT) AS catalogue_tracks, CAST(sum(CASE WHEN catalogue THEN 0 ELSE jobs END) AS BIGINT) AS per_track,
CAST(sum(CASE WHEN catalogue THEN (CASE WHEN mbid IS NULL THEN 1 ELSE 0 END) + 1 ELSE jobs END) AS BIGINT) AS calls FROM s GROUP BY ALL""",
    "match_tiers": CATALOGUE + "SELECT artist_key, track, ['exact', 'base', 'folded'][t + 1] AS tier, title_key FROM tier",
    "match_tracks": CATALOGUE + f""", h AS (SELECT tier.*, idx.rg_id, idx.ord AS hit, rel.title, rel.first_release, coalesce(nullif({norm(r"trim(regexp_replace(title, '(?i)(\s*(?:[(\[][^)\]]*\b(?:deluxe|edition)\b[^)\]]*[)\]]|-\s*remastered)\s*)+$', ''))")}, ''), {norm('title')}) AS edition
  FROM tier JOIN idx USING (artist_key, title_key) JOIN rel ON rel.artist_key = tier.artist_key AND rel.rg_id = idx.rg_id),
e AS (SELECT *, row_number() OVER (PARTITION BY artist_key, track, edition ORDER BY coalesce(nullif(first_release, ''), '9999'), hit) AS n FROM h)
SELECT artist_key, track, ['exact', 'base', 'folded'][t + 1] AS tier, rg_id, title, first_release, edition, row_number() OVER (PARTITION BY artist_key, track ORDER BY coalesce(nullif(first_release, ''), '9999'), hit) AS place FROM e WHERE n = 1""",
    "recording_groups": """WITH r AS (SELECT p_brand AS artist, p_name AS track, p_brand || '/' || p_type AS rg_id, CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(1950 + p_size AS VARCHAR) END AS first_release, 'rec-' || p_partkey AS recording_id, p_partkey FROM part)
SELECT artist, track, rg_id, first_release, recording_id FROM (SELECT *, row_number() OVER (PARTITION BY artist, track, rg_id ORDER BY coalesce(first_release, '9999'), p_partkey) AS n FROM r) WHERE n = 1""",
    "album_groups": """SELECT 'spotify:' || p_partkey AS rg_id, p_name AS title, CASE WHEN p_size % 3 = 0 AND p_size % 10 BETWEEN 4 AND 8 THEN 'EP' WHEN p_size % 3 = 0 THEN 'Single' ELSE 'Album' END AS primary_type, p_size % 3 = 1 AS compilation FROM part""",
    "artist_albums": f"""WITH f AS (SELECT p_brand AS artist, p_type || '-' || (p_partkey % 40) AS id, p_name AS name, p_partkey AS ord FROM part WHERE p_partkey % 3 <> 0), d AS (SELECT artist, id, min(ord) AS ord FROM f GROUP BY ALL)
SELECT artist, least(count(*), 100) AS albums, count(*) > 100 AS truncated FROM d GROUP BY ALL""",
    "release_exists": f"""WITH q AS (SELECT DISTINCT p_brand AS artist, p_type AS title FROM part), f AS (SELECT p_brand AS artist, p_type AS title, CASE WHEN p_partkey % 4 = 0 THEN lower(p_type) ELSE p_name END AS hit FROM part WHERE p_partkey % 2 = 0)
SELECT q.artist, q.title, coalesce(bool_or({norm_release('hit')} = {norm_release('q.title')}), false) AS exists FROM q LEFT JOIN f ON f.artist = q.artist AND f.title = q.title GROUP BY ALL""",
    "cache_freshness": """WITH c AS (SELECT 'mb:' || (o_custkey % 500) AS k, CASE WHEN o_orderkey % 3 = 0 THEN '{"groups": []}' WHEN o_orderkey % 3 = 1 THEN '{"found": false}' ELSE '{"groups": [1]}' END AS v, CAST(epoch(o_orderdate) AS BIGINT) AS created FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY created DESC, v DESC) AS i FROM c)
SELECT k, v, created FROM n WHERE i = 1 AND (v LIKE '%[1]%' OR created >= 900000000 - 30 * 86400)""",
    "edit_distance_pairs": "SELECT a.p_name AS a, b.p_name AS b, greatest(1, CAST(floor(greatest(length(a.p_name), length(b.p_name)) / 10) AS INT)) AS budget FROM (SELECT DISTINCT p_name FROM part) a, (SELECT DISTINCT p_name FROM part) b WHERE a.p_name < b.p_name AND levenshtein(a.p_name, b.p_name) <= greatest(1, floor(greatest(length(a.p_name), length(b.p_name)) / 10))",
    "profile": f"""WITH plays AS ({PLAYS_SQL}) SELECT "user", count(*) AS scrobbles_ingested, count(DISTINCT artist) AS distinct_artists, count(DISTINCT (artist, album)) FILTER (WHERE album <> '') AS distinct_albums, count(DISTINCT (artist, track)) AS distinct_tracks FROM plays GROUP BY ALL""",
    "summary_by_detector": SCORE + 'SELECT "user", detector, count(*) AS issues, CAST(sum(plays_affected) AS BIGINT) AS plays_affected FROM issues GROUP BY ALL',
    "bucket_scores": SCORE + """, t AS (SELECT "user", sum(plays) AS n, count(DISTINCT (artist, album)) FILTER (WHERE album <> '') AS strings FROM cells GROUP BY ALL),
b AS (SELECT "user", CASE detector WHEN 'D4' THEN 'album_integrity' WHEN 'D5' THEN 'album_integrity' WHEN 'D11' THEN 'artist_integrity' ELSE 'duplicate_rate' END AS bucket, count(*) AS issue_count, sum(plays_affected) AS plays_affected,
  sum(CASE class WHEN 'error' THEN 3 WHEN 'split' THEN 2 WHEN 'review' THEN 0 ELSE 1 END * (1 + log10(1 + plays_affected))) AS penalty, sum(CASE WHEN class <> 'review' THEN 1 ELSE 0 END) AS actionable FROM issues GROUP BY ALL),
a AS (SELECT "user", bucket, greatest(strings, 80) AS d FROM t, (VALUES ('album_integrity'), ('artist_integrity'), ('duplicate_rate'), ('era_consistency')) v(bucket))
SELECT "user", bucket, CASE WHEN coalesce(penalty, 0) = 0 THEN 100 ELSE greatest(1, CAST(round(100 * 0.06 * d / (penalty + 0.06 * d)) AS INT)) END AS subscore, coalesce(issue_count, 0) AS issue_count, CAST(coalesce(plays_affected, 0) AS BIGINT) AS plays_affected, CAST(coalesce(actionable, 0) AS BIGINT) AS actionable FROM a LEFT JOIN b USING ("user", bucket)""",
    "landed_pages": EVENTS + 'SELECT "user", uts, artist, album, track FROM plays',
    "resume_points": """WITH n AS (SELECT 'u' || CAST(user_id % 8 AS VARCHAR) AS "user", count(*) AS c, min(CAST(floor(epoch(ts)) AS BIGINT)) - 1 AS anchor FROM events GROUP BY ALL)
SELECT "user", (c + 199) // 200 AS fetched, (c + 199) // 200 + 1 AS total_pages, (c + 199) // 200 + 1 AS next_page, anchor FROM n""",
}
