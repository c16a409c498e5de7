"""Game rules and default parameters that results depend on."""

from __future__ import annotations

# Squad rules.
POSITIONS = ["GK", "DEF", "MID", "FWD"]
SQUAD_QUOTA = {"GK": 2, "DEF": 5, "MID": 5, "FWD": 3}
LINEUP_LEAST = {"GK": 1, "DEF": 3, "MID": 2, "FWD": 1}
LINEUP_MOST = {"GK": 1, "DEF": 5, "MID": 5, "FWD": 3}
SQUAD_SIZE, LINEUP_SIZE = 15, 11
BUDGET, CLUB_CAP = 100.0, 3
POSITION_NAMES = {
    "1": "GK", "2": "DEF", "3": "MID", "4": "FWD", "GK": "GK", "GKP": "GK", "DEF": "DEF", "MID": "MID", "FWD": "FWD", "Goalkeeper": "GK", "Defender": "DEF", "Midfielder": "MID", "Forward": "FWD",
}

# Points by position.
GOAL_POINTS = {"GK": 6, "DEF": 6, "MID": 5, "FWD": 4}
CLEAN_SHEET_POINTS = {"GK": 4, "DEF": 4, "MID": 1, "FWD": 0}
CONCEDED_POINTS = {"GK": -1, "DEF": -1, "MID": 0, "FWD": 0}
ASSIST_POINTS, YELLOW_POINTS, RED_POINTS, OWN_GOAL_POINTS, MISSED_PENALTY_POINTS, SAVED_PENALTY_POINTS = 3, -1, -3, -2, -2, 5

# How a statistic of several fixtures in one gameweek becomes one.
SUMMED = [
    "points", "minutes", "goals", "assists", "bonus", "bps", "clean_sheets", "goals_conceded", "saves", "yellow_cards", "red_cards", "own_goals", "penalties_missed", "penalties_saved", "transfers_in", "transfers_out",
]
AVERAGED = ["xG", "xA", "xP", "influence", "creativity", "threat", "ict_index", "expected_goals_conceded"]

# The five latent states of form, and the scalar model over points.
STATES = ["Injured", "Slump", "Average", "Good", "Star"]
EMISSIONS = [(0.5, 0.5), (2.0, 1.0), (4.0, 1.5), (6.0, 1.5), (8.5, 2.0)]
TRANSITION = [
    [0.60, 0.25, 0.10, 0.05, 0.00],
    [0.05, 0.50, 0.35, 0.08, 0.02],
    [0.02, 0.10, 0.55, 0.25, 0.08],
    [0.02, 0.05, 0.15, 0.55, 0.23],
    [0.01, 0.02, 0.07, 0.30, 0.60],
]
INITIAL = [0.05, 0.10, 0.50, 0.25, 0.10]
VARIANCE_FLOOR = 1.0

# The two-feature model (expected points, share of minutes) by position.
STAR_ANCHOR = {"GK": 6.8, "DEF": 6.5, "MID": 7.5, "FWD": 7.2}
OTHER_ANCHOR = 7.0
LADDER = [(0.0, 0.0), (0.25, 0.75), (0.45, 0.95), (0.68, 1.0), (1.0, 1.0)]
LADDER_VARIANCE = [(0.05, 0.001), (0.8, 0.05), (1.2, 0.02), (1.8, 0.01), (2.4, 0.005)]

# The random walk of the Kalman filter.
PROCESS_NOISE, OBSERVATION_NOISE, FIRST_MEAN, FIRST_VARIANCE = 1.0, 4.0, 4.0, 2.0

# Patterns of news texts, searched in lower case; the first group that matches decides.
UNAVAILABLE = [r"out for \d+\s*(weeks?|months?)", "ruled out", "sidelined", "long[- ]term injury", "season[- ]ending", "suspended"]
DOUBTFUL = ["doubtful", "unlikely", "50%", "touch and go", "late fitness test"]
ROTATION = ["rotation risk", "benched", "not starting", "limited minutes"]
POSITIVE = ["back in training", "available", "fit", "recovered", "expected to start"]
SURE = ["ruled out", "confirmed", "definitely"]
LIKELY = ["likely", "expected", "should"]
UNSURE = ["maybe", "possible", "unclear"]
STATUS_WORDS = {"i": "injured", "s": "suspended", "u": "unavailable", "d": "doubtful", "n": "not in squad"}

# What a category of news does to the next step: factors on the way into states, and on process noise.
STATE_BOOST = {"unavailable": [10.0, 2.0, 1.0, 1.0, 1.0], "doubtful": [3.0, 2.0, 1.0, 1.0, 1.0], "rotation": [1.0, 2.0, 1.5, 1.0, 1.0], "positive": [1.0, 1.0, 1.0, 2.0, 1.5]}
PROCESS_SHOCK = {"unavailable": 5.0, "doubtful": 2.0, "rotation": 1.5}
NEWS_LIMITS = {"unavailable": 0.1, "doubtful": 0.6, "rotation_risk": 0.5, "positive_least": 0.85, "positive_below": 1.0, "positive_risk": 0.1}
FIXTURE_NOISE = [0.8, 0.9, 1.0, 1.2, 1.5]

# The fusion of the two scalar models.
DEFAULT_ALPHA, ALPHA_FLOOR, ALPHA_STEP, ALPHA_HISTORY = 0.8, 0.5, 0.05, 8
