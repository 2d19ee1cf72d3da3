"""Fixed values of the race domain. All of them must equal these figures for results to match."""

from __future__ import annotations

# Replacement for a missing number, per column.
MISSING_DEFAULTS = {
    "finish": 5.0,
    "last3f": 35.5,
    "pass4": 8.0,
    "odds": 15.0,
    "weight": 480.0,
    "carry": 55.0,
    "age": 3.0,
    "distance": 1600.0,
    "field": 14.0,
}
# The older feature set replaces these two differently.
MISSING_DEFAULTS_OLD = {"finish": 8.0, "last3f": 37.0}

# Right-closed bin edges and the code of each bin.
BINS = {
    "distance": ([0, 1200, 1400, 1800, 2200, 9999], [0, 1, 2, 3, 4], 2),
    "weight": ([0, 440, 480, 520, 9999], [0, 1, 2, 3], 1),
    "rest": ([-1, 6, 14, 35, 63, 180, 9999], [0, 1, 2, 3, 4, 5], 2),
    "rest_old": ([0, 14, 28, 60, 180, 9999], [0, 1, 2, 3, 4], 2),
    "rest_regional": ([-1, 14, 35, 90, 9999], [0, 1, 2, 3], 1),
    "bracket": ([0, 3, 6, 8], [0, 1, 2], 1),
    "pace": ([-999, -1, 1, 999], [0, 1, 2], 1),
}

# Text needles and codes, tested in order.
SEX_CODES = [("牡", 0), ("牝", 1), ("セ", 2), ("騸", 2)]
SURFACE_CODES = [("芝", 0), ("ダ", 1)]
SURFACE_OTHER = 2
GOING_CODES = [("良", 0), ("稍", 1), ("重", 2), ("不", 3)]
LOCATION_CODES = [("美", 0), ("栗", 1), ("地", 2), ("外", 3)]

# Exact code of a surface, going or sex text.
SURFACE_MAP = {"芝": 0, "ダ": 1, "ダート": 1, "障": 2}
GOING_MAP = {"良": 0, "稍": 1, "稍重": 1, "重": 2, "不": 3, "不良": 3}
SEX_MAP = {"牡": 0, "牝": 1, "セ": 2, "騸": 2}

# Venue number by name.
COURSE_MAP = {
    "札幌": 0, "函館": 1, "福島": 2, "新潟": 3, "東京": 4, "中山": 5, "中京": 6, "京都": 7, "阪神": 8, "小倉": 9,
    "大井": 10, "川崎": 11, "船橋": 12, "浦和": 13, "園田": 14, "姫路": 15, "門別": 16,
    "盛岡": 17, "水沢": 18, "金沢": 19, "笠松": 20, "名古屋": 21, "高知": 22, "佐賀": 23, "帯広": 24,
}

# Class name by lower bound of the class code.
CLASS_LADDER = [
    (190, "G1"), (160, "G2G3"), (130, "OP"), (100, "3win"), (67, "2win"),
    (34, "1win"), (16, "maiden"), (5, "newcomer"),
]

# Going text, wind words and directions in the order they are tested.
WIND_SPEEDS = [("非常に強", 15.0), ("強く", 10.0), ("強い", 10.0), ("やや強", 7.0), ("弱く", 2.0), ("弱い", 2.0)]
WIND_DEFAULT = 4.0
WIND_DIRECTIONS = [
    "北北西", "北北東", "北西", "北東", "南南西", "南南東", "南西", "南東",
    "西北西", "西南西", "東北東", "東南東", "北", "南", "東", "西",
]
# Rain in mm by lower bound of the rain probability in percent.
RAIN_BY_PROBABILITY = [(80, 5.0), (60, 2.0), (40, 0.5)]
# The sixteen wind directions by number, from north (16 and 1) clockwise as the observations count them.
COMPASS = ["北", "北北東", "北東", "東北東", "東", "東南東", "南東", "南南東", "南", "南南西", "南西", "西南西", "西", "西北西", "北西", "北北西"]
WEATHER_DEFAULTS = {"temperature": 15.0, "humidity": 60.0, "wind_speed": 3.0, "precipitation": 0.0}

# Stake per race and the ticket scale that brings each ticket to that stake.
STAKE = 700
TICKET_SCALE = {"tansho": 7.0, "umaren": 3.5, "wide": 3.5, "trio": 1.0, "tierce": 7.0}

# Ticket, hit rate and published return per race class.
CLASS_PROFILE = {
    "A": ("trio", 44.5, 205.3, 30),
    "B": ("trio", 45.2, 236.9, 5),
    "C": ("trio", 33.7, 285.6, 22),
    "D": ("trio", 27.0, 136.0, 40),
    "E": ("umaren", 53.4, 118.0, 2),
    "X": ("trio", 35.5, 330.5, 4),
}

# The same per race class of regional courses, and whether the class is bought at all.
REGIONAL_PROFILE = {
    "A": ("trio", 65.2, 366.0, True),
    "B": ("trio", 49.4, 431.9, True),
    "C": ("wide", 0.0, 0.0, False),
    "D": ("wide", 93.9, 0.0, True),
    "E": ("umaren", 60.0, 349.8, True),
    "F": ("wide", 83.0, 0.0, True),
    "G": ("wide", 0.0, 0.0, False),
    "X": ("trio", 0.0, 0.0, False),
}

# Component weights of the blended score per version.
SCORE_WEIGHTS = {
    "v3": {"ai": 0.55, "pop": 0.10, "apt": 0.08, "pace": 0.08, "agari": 0.08, "course": 0.04, "other": 0.04, "time": 0.03},
    "v5": {"ai": 0.60, "pop": 0.08, "apt": 0.07, "pace": 0.07, "agari": 0.07, "course": 0.04, "other": 0.04, "time": 0.03},
    "v6": {"ai": 0.65, "pop": 0.06, "apt": 0.06, "pace": 0.06, "agari": 0.06, "course": 0.04, "other": 0.04, "time": 0.03},
    "v9_odds": {"ai": 0.65, "odds": 0.08, "apt": 0.06, "pace": 0.06, "agari": 0.05, "course": 0.04, "other": 0.03, "pop": 0.03},
    "v9": {"ai": 0.70, "pop": 0.06, "apt": 0.06, "pace": 0.06, "agari": 0.05, "course": 0.04, "other": 0.03},
    "base": {"ai": 0.45, "pop": 0.15, "apt": 0.10, "pace": 0.10, "agari": 0.10, "course": 0.05, "other": 0.05},
    "regional_odds": {"ai": 0.27, "odds": 0.10, "pop": 0.03, "pace": 0.18, "agari": 0.08, "jockey": 0.10, "apt": 0.08, "time": 0.08, "course": 0.04, "other": 0.04},
    "regional": {"ai": 0.27, "pop": 0.13, "pace": 0.18, "agari": 0.08, "jockey": 0.10, "apt": 0.08, "time": 0.08, "course": 0.04, "other": 0.04},
}

# Score change per running style (1 leads .. 4 closes).
GOING_STYLE_DELTA = {1: 0.015, 2: 0.020, 3: -0.005, 4: -0.020}
PACE_STYLE_DELTA = {
    "high": {1: -0.025, 2: -0.010, 3: 0.020, 4: 0.025},
    "slow": {1: 0.025, 2: 0.020, 3: -0.010, 4: -0.025},
    "middle": {1: 0.005, 2: 0.010, 3: 0.005, 4: -0.010},
}
BIAS_STYLE_FACTOR = {1: 0.04, 2: 0.03, 3: -0.02, 4: -0.04}

# Workout text codes.
INTENSITY_MAP = {"一杯": 3, "強め": 2, "G前仕掛け": 2, "G前仕掛": 2, "馬なり": 1, "馬ナリ": 1, "直線強め": 2}
EVALUATION_MAP = {"A": 5, "B": 4, "C": 3, "D": 2, "E": 1}
COMPANION_MAP = {"先着": 2, "同入": 1, "遅れ": 0}

# Accepted spellings per column of a regional result file.
HEADER_ALIASES = {
    "horse_name": ["horse_name", "馬名"],
    "finish": ["finish", "着順"],
    "jockey": ["jockey", "騎手"],
    "age": ["age", "馬齢"],
    "sex": ["sex", "性別"],
    "distance": ["distance", "距離"],
    "surface": ["surface", "芝ダ"],
    "condition": ["condition", "馬場"],
    "horse_weight": ["horse_weight", "馬体重"],
    "weight_carry": ["weight_carry", "斤量"],
    "num_horses": ["num_horses", "頭数"],
    "horse_num": ["horse_num", "馬番"],
    "course_name": ["course_name", "競馬場"],
    "last3f": ["last3f", "上がり3F"],
    "prize": ["prize", "賞金"],
    "father": ["father", "父"],
    "pass_c4": ["pass_c4", "通過順4"],
    "trainer": ["trainer", "調教師"],
    "location": ["location", "所属"],
    "year": ["year", "年"],
    "month": ["month", "月"],
    "day": ["day", "日"],
    "race_id": ["race_id", "レースID"],
    "margin_time": ["margin_time", "着差"],
    "mother_father": ["mother_father", "母の父"],
}
# Fragments that identify a workout column, tested in order.
WORKOUT_HEADER_PARTS = [
    ("race_horse_key", ["レース馬キー", "race_horse_key", "キー"]),
    ("training_date", ["調教日", "training_date", "日付"]),
    ("place", ["場所", "place"]),
    ("intensity", ["強さ", "intensity", "追切"]),
    ("time_4f", ["4F", "4f"]),
    ("time_3f", ["3F", "3f"]),
    ("time_1f", ["1F", "1f"]),
    ("evaluation", ["評価", "evaluation"]),
    ("awase_result", ["併せ", "awase"]),
    ("tr_course", ["コース", "course"]),
]

# Column names, in file order, of the headerless entries file.
ENTRY_COLUMNS = (
    "year month day kai course nichi race_num race_name class_code surface course_code distance condition horse_name "
    "sex age jockey weight_carry num_horses umaban finish finish2 abnormal_code time_margin popularity run_time "
    "run_time_x10 empty pass1 pass2 pass3 pass4 agari_3f horse_weight trainer location prize horse_id jockey_id "
    "trainer_id race_id owner breeder father mother bms coat_color birthday tansho_odds mark1 mark2 training_4f"
).split()

# 1-based start and length of the fields in regional runner and race records (bytes).
RUNNER_FIELDS = {
    "race_date": (12, 8), "course": (20, 2), "race_no": (22, 2), "umaban": (24, 2), "horse_id": (26, 10),
    "horse_name": (36, 36), "sex": (72, 1), "age": (76, 2), "jockey_code": (78, 5), "jockey": (83, 8),
    "trainer": (104, 8), "weight": (120, 3), "finish": (127, 3), "minutes": (130, 3), "tenths": (133, 3),
}
RACE_FIELDS = {"race_date": (12, 8), "course": (20, 2), "race_no": (22, 2), "race_class": (24, 1), "distance": (25, 4)}
# Start of the first odds group and group length in an odds record.
ODDS_START, ODDS_WIDTH = 44, 8

# Fit of a sire's offspring to turf, dirt, sprint, mile, middle and long distances.
SIRE_FIT = {
    "ディープインパクト": (1.0, 0.3, 0.5, 0.9, 1.0, 0.8),
    "キングカメハメハ": (0.8, 0.7, 0.6, 0.8, 0.9, 0.7),
    "ロードカナロア": (0.9, 0.5, 1.0, 0.8, 0.5, 0.2),
    "ドゥラメンテ": (0.9, 0.5, 0.4, 0.8, 1.0, 0.8),
    "エピファネイア": (0.9, 0.4, 0.3, 0.7, 1.0, 0.9),
    "ハーツクライ": (0.9, 0.3, 0.2, 0.6, 0.9, 1.0),
    "キタサンブラック": (0.9, 0.4, 0.3, 0.7, 0.9, 1.0),
    "モーリス": (0.8, 0.5, 0.5, 0.9, 0.8, 0.5),
    "オルフェーヴル": (0.8, 0.6, 0.3, 0.6, 0.9, 1.0),
    "ヘニーヒューズ": (0.2, 1.0, 1.0, 0.7, 0.4, 0.1),
    "ダイワメジャー": (0.8, 0.5, 0.7, 1.0, 0.6, 0.3),
    "ルーラーシップ": (0.8, 0.5, 0.3, 0.7, 0.9, 0.9),
    "ホッコータルマエ": (0.2, 1.0, 0.7, 0.9, 0.8, 0.4),
    "シニスターミニスター": (0.1, 1.0, 0.8, 0.9, 0.6, 0.3),
    "パイロ": (0.1, 1.0, 0.9, 0.8, 0.5, 0.2),
    "コントレイル": (0.9, 0.3, 0.3, 0.7, 1.0, 0.9),
    "ドレフォン": (0.5, 0.8, 0.8, 0.8, 0.6, 0.3),
    "サウスヴィグラス": (0.1, 1.0, 1.0, 0.6, 0.2, 0.0),
    "ブリックスアンドモルタル": (0.8, 0.5, 0.4, 0.8, 0.9, 0.7),
    "スワーヴリチャード": (0.8, 0.5, 0.3, 0.7, 0.9, 0.9),
}

# Which features are known before the race, by exact name.
FEATURE_STATUS = {
    "OK": """
        weight_carry age distance course_enc surface_enc sex_enc num_horses horse_num bracket jockey_wr_calc
        jockey_course_wr_calc jockey_surface_wr trainer_top3_calc prev_finish prev2_finish prev3_finish prev_last3f
        prev2_last3f prev_pass4 prev_prize prev_odds_log avg_finish_3r best_finish_3r top3_count_3r finish_trend
        avg_last3f_3r dist_change dist_change_abs rest_days rest_category sire_enc bms_enc dist_cat age_sex season
        age_season horse_num_ratio bracket_pos carry_diff age_group surface_dist_enc cond_surface course_surface
        location_enc is_nar training_time_filled has_training training_per_dist horse_career_races horse_career_wr
        horse_career_top3r sire_surface_wr sire_dist_wr bms_surface_wr wood_best_4f_filled has_wood_training
        prev_horse_weight
    """.split(),
    "WARN": ["condition_enc"],
    "EXCLUDED": "odds_log horse_weight weight_change weight_change_abs weight_cat weight_cat_dist".split(),
}

# The same for the regional models.
FEATURE_STATUS_REGIONAL = {
    "LEAK": "finish finish_pos finish_time finish_time_sec target tansho_payout umaren_payout trio_payout wide_payout".split(),
    "CAUTION": "weight_change condition_enc horse_weight".split(),
    "SAFE": """
        odds_log prev_odds_log pop_rank num_horses distance surface_enc course_enc weight_carry age sex horse_num bracket
        jockey_wr jockey_place_rate trainer_wr prev_finish prev2_finish prev3_finish avg_finish_3r best_finish_3r
        top3_count_3r finish_trend rest_days rest_category dist_cat weight_cat age_group horse_num_ratio bracket_pos
        carry_diff dist_change dist_change_abs is_nar
    """.split(),
}
