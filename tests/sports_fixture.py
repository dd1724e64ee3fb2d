"""Deterministic sports-schema inputs for tests (3 seasons x 12 teams).

Built to contain every trap the pipeline must handle: a mid-season coach
change, a day without a covering coach, a team missing from one ranking
list, a game with zero free-throw attempts, neutral-site games, a play-in
seed (``W16a``), a team with at most five games, and a coach who moves to
a team with a smaller id.
"""

from __future__ import annotations

import random

from duelframe.sources import schemas as S

SEASONS = (2023, 2024, 2025)
TEAMS = list(range(1101, 1113))
SHORT_TEAM = 1112          # plays only 4 games a season
CONFS = {t: ("acc" if t < 1104 else "sec" if t < 1107 else "mwc" if t < 1110 else "wcc") for t in TEAMS}


def _box(rng: random.Random, fta_zero: bool = False) -> list[int]:
    fga = rng.randint(50, 70)
    fgm = rng.randint(20, fga - 15)
    fga3 = rng.randint(15, 30)
    fgm3 = rng.randint(3, fga3 - 5)
    fta = 0 if fta_zero else rng.randint(8, 30)
    ftm = 0 if fta_zero else rng.randint(0, fta)
    return [fgm, fga, fgm3, fga3, ftm, fta, rng.randint(5, 15), rng.randint(15, 30),
            rng.randint(8, 20), rng.randint(5, 18), rng.randint(2, 12), rng.randint(0, 8),
            rng.randint(10, 25)]


def build(spark) -> dict:
    rng = random.Random(42)
    regular, tourney, compact, ctour = [], [], [], []
    fta_zero_done = False
    for season in SEASONS:
        regulars = [t for t in TEAMS if t != SHORT_TEAM]
        for day in range(10, 131, 6):
            order = regulars[:]
            rng.shuffle(order)
            for i in range(0, len(order) - 1, 2):
                a, b = order[i], order[i + 1]
                w, l = (a, b) if rng.random() < 0.5 else (b, a)
                loc = rng.choice(["H", "H", "A", "N"])
                ws, ls = rng.randint(65, 95), 0
                ls = rng.randint(50, ws - 1)
                fz = not fta_zero_done and season == 2023 and day == 34
                fta_zero_done = fta_zero_done or fz
                regular.append([season, day, w, ws, l, ls, loc, 0] + _box(rng) + _box(rng, fz))
        # the short team: 4 games against team 1101 on days 11, 23, 35, 47
        for k, day in enumerate((11, 23, 35, 47)):
            w, l = (SHORT_TEAM, 1101) if k % 2 else (1101, SHORT_TEAM)
            regular.append([season, day, w, 70 + k, l, 60 + k, "N", 0] + _box(rng) + _box(rng))
        # conference tournament: marked subset of late regular games
        for row in regular:
            if row[0] == season and row[1] == 130:
                ctour.append([season, CONFS[row[2]], row[1], row[2], row[4]])
        # tournament: 4 rounds on neutral courts among the first 8 teams
        alive = TEAMS[:8]
        day = 136
        while len(alive) > 1:
            nxt = []
            for i in range(0, len(alive), 2):
                a, b = alive[i], alive[i + 1]
                w, l = (a, b) if rng.random() < 0.6 else (b, a)
                ws = rng.randint(60, 90)
                ls = rng.randint(45, ws - 1)
                tourney.append([season, day, w, ws, l, ls, "N", 0] + _box(rng) + _box(rng))
                compact.append([season, day, w, ws, l, ls, "N", 0])
                nxt.append(w)
            alive = nxt
            day += 2
    # compact history reaches back before the detailed seasons
    for season in (2001, 2002):
        for i in range(0, 8, 2):
            compact.append([season, 136, TEAMS[i], 70, TEAMS[i + 1], 60, "N", 0])

    confs = [[s, t, CONFS[t]] for s in SEASONS for t in TEAMS]
    coaches = []
    for s in list(SEASONS) + [2001, 2002]:
        for t in TEAMS:
            if t == 1103 and s == 2024:      # mid-season change, day 70 uncovered
                coaches += [[s, t, 0, 69, "c_early"], [s, t, 71, 154, "c_late"]]
            elif t == 1108 and s == 2025:    # coach of 1110 moves to the smaller id 1108
                coaches.append([s, t, 0, 154, "coach_1110"])
            elif t == 1110 and s == 2025:
                coaches.append([s, t, 0, 154, "c_new_1110"])
            else:
                coaches.append([s, t, 0, 154, f"coach_{t}"])
    seeds = []
    for s in SEASONS:
        for i, t in enumerate(TEAMS[:8]):
            seeds.append([s, f"W{i + 1:02d}" if i < 7 else "W16a", t])
    ords = []
    for system in ("AP", "POM", "NET"):
        for s in SEASONS:
            for day in (30, 60, 90, 120):
                ranked = [t for t in TEAMS if not (system == "AP" and t == 1105)]
                rng.shuffle(ranked)
                for r, t in enumerate(ranked, start=1):
                    ords.append([s, day, system, t, r])
    teams = [[t, f"Team {t}", 1985, 2025] for t in TEAMS]

    def df(rows, schema):
        return spark.createDataFrame(rows, schema)

    ordinals = df(ords, S.ORDINALS)
    return {
        "regular": df(regular, S.DETAILED_RESULTS),
        "tourney": df(tourney, S.DETAILED_RESULTS),
        "compact": df(compact, S.COMPACT_RESULTS),
        "conf_games": df(ctour, S.CONFERENCE_TOURNEY_GAMES),
        "team_confs": df(confs, S.TEAM_CONFERENCES),
        "coaches": df(coaches, S.TEAM_COACHES),
        "seeds": df(seeds, S.TOURNEY_SEEDS),
        "ordinals": ordinals,
        "systems": {n: ordinals.where(ordinals.SystemName == n) for n in ("AP", "POM", "NET")},
        "teams": df(teams, S.TEAMS),
    }
