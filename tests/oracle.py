"""A plain model of the detectors over lists of plays, written for the tests alone."""

from __future__ import annotations

from collections import Counter, defaultdict

from playtide.functions import eras, strings, titles


def play(uts, artist, track, album="", album_mbid="", artist_mbid="", track_mbid="", user="u"):
    return {"user": user, "uts": uts, "artist": artist, "album": album, "track": track, "artist_mbid": artist_mbid, "album_mbid": album_mbid, "track_mbid": track_mbid}


def frame(spark, plays):
    """Plays as a DataFrame; their order is the order of input."""
    from playtide.sources.plays import SCHEMA

    return spark.createDataFrame([(p["user"], i, p["uts"], p["artist"], p["album"], p["track"], p["artist_mbid"], p["album_mbid"], p["track_mbid"]) for i, p in enumerate(plays)], SCHEMA)


def partition(plays):
    taggers = {strings.norm(p["artist"]) for p in plays if eras.parse(p["album"]).explicit}
    era, rest = [], []
    for p in plays:
        e = eras.parse(p["album"])
        (era if e.explicit or (e.tagged and strings.norm(p["artist"]) in taggers) else rest).append(p)
    return era, rest


def splits(rest):
    """D4 as {(artist, track): (reason, members)}."""
    ids = defaultdict(set)
    for p in rest:
        if p["album"] and p["album_mbid"]:
            ids[strings.norm(p["artist"]), strings.norm(p["album"])].add(p["album_mbid"])
    groups = {}
    for p in rest:
        groups.setdefault((strings.norm(p["artist"]), strings.track_identity(p["track"])), []).append(p)
    out = {}
    for (key, _), rows in groups.items():
        count = Counter(p["album"] or strings.NO_ALBUM for p in rows)
        if len(count) < 2:
            continue
        order = sorted(count, key=lambda a: -count[a])
        track, total = rows[0]["track"], len(rows)
        a, b = (ids[key, strings.norm(x)] for x in order[:2])
        verdict = "unknown" if not a or not b else "same" if a & b else "different"
        kinds = [titles.album_kind(x, track) for x in order]
        span = {x: (min(p["uts"] for p in rows if (p["album"] or strings.NO_ALBUM) == x), max(p["uts"] for p in rows if (p["album"] or strings.NO_ALBUM) == x)) for x in order}
        migration = False
        if len(order) == 2:
            x, y = sorted(order, key=lambda n: span[n][0])
            migration = span[x][1] <= span[y][0] and titles.plausible_pre_release(x, y, track)
        singleish = any(k in ("missing", "compilation", "edition variant", "single or EP") for k in kinds[:2])
        reason = (
            "proven" if verdict == "same" else "disproven" if verdict == "different" else "structural" if titles.is_structural(track)
            else "stray" if count[order[-1]] <= 1 and total <= 4 else "plain-albums" if not migration and not singleish else "migration" if migration else "candidate"
        )
        out[rows[0]["artist"], track] = (reason, [(x, count[x], k) for x, k in zip(order, kinds, strict=True)])
    return out


def fuzzy_artists(rest):
    """Pairs of D1's second part, as {frozenset of names}."""
    count, known, first = Counter(), defaultdict(set), {}
    for p in rest:
        count[p["artist"]] += 1
        known[p["artist"]].add(strings.norm_title(p["track"]))
        first.setdefault(strings.norm_artist(p["artist"]), len(first))
    out = set()
    names = list(count)
    for a in names:
        for b in names:
            x, y = strings.norm_artist(a), strings.norm_artist(b)
            if first[x] >= first[y] or abs(len(x) - len(y)) > 3 or not known[a] & known[b] or strings.digits_only_differ(a, b) or strings.case_only(a, b):
                continue
            budget = strings.typo_budget(x, y)
            if (strings.similar(x, y) >= 0.9 or strings.edit_distance(x, y, budget) <= budget) and min(count[a], count[b]) <= 0.4 * max(count[a], count[b]):
                out.add(frozenset((a, b)))
    return out


def duplicates(plays, seconds=30):
    order = sorted(plays, key=lambda p: p["uts"])
    return [c["uts"] for p, c in zip(order, order[1:], strict=False) if c["uts"] - p["uts"] <= seconds and strings.norm_title(p["track"]) == strings.norm_title(c["track"]) and strings.norm(p["artist"]) == strings.norm(c["artist"])]


def merged(rest, found):
    """Chart after moving splits, found as [(artist, track, plays, later, members)] in order of plays."""
    chart = Counter((p["artist"], p["album"]) for p in rest if p["album"])
    order = ["album", "edition variant", "compilation", "single or EP", "single (album titled after the track)", "missing"]
    for artist, members, later in found:
        target = None
        if later:
            w = strings.norm(later)
            target = next((n for n, _, _ in members if strings.norm(n) == w), None) or next((n for n, _, _ in members if w in strings.norm(n) or strings.norm(n) in w), None)
        if not target:
            target = min(members, key=lambda m: order.index(m[2]))[0]
        for n, c, _ in members:
            moved = min(chart.get((artist, n), 0), c)
            if n != target and moved:
                chart[artist, n] -= moved
                chart[artist, target] += moved
    return chart
