"""Schemas of the raw inputs and of the stored tables, as Spark DDL."""

from __future__ import annotations

# Names of the review attributes, in the order in which they are stored.
PILLARS = [
    "multiplayer", "immersion", "community", "replayability", "story", "monetizationModel",
    "gameplay", "controls", "graphics", "customization", "audio", "difficulty",
]
PURCHASE_FLAGS = ["steam_purchase", "received_for_free", "voted_up", "primarily_steam_deck"]
QUALITY_FLAGS = [
    "isUseful", "containsPositiveAspects", "containsNegativeAspects",
    "actuallyRecommendsTitle", "containsBugDescription",
]
BOOLEANS = PURCHASE_FLAGS + QUALITY_FLAGS
HARDWARE = ["hw_resolution", "hw_ram", "hw_vram", "hw_gpu", "hw_os", "hw_cpu_vendor"]
BASKET_HARDWARE = ["hw_ram", "hw_vram", "hw_os"]
RULE_METRICS = [
    "antecedent_support", "consequent_support", "support", "confidence", "lift", "leverage", "conviction",
]

# Numbers that arrive either as text or as numbers are read as STRING and cast later.
RAW_REVIEW = (
    "struct<recommendationid: string, review: string, language: string, "
    "timestamp_created: long, timestamp_updated: long, "
    "steam_purchase: boolean, received_for_free: boolean, voted_up: boolean, "
    "weighted_vote_score: string, primarily_steam_deck: boolean, "
    "author: struct<playtime_at_review: string>, "
    "hardware: struct<os: string, dx_video_card: string, cpu_vendor: string, system_ram: string, "
    "vram_size: string, screen_width: int, screen_height: int>>"
)
RAW_REVIEW_PAGE = f"app_id long, cursor string, reviews array<{RAW_REVIEW}>"
RAW_PLAYER_PAGE = "app_id long, nextCursor string, history array<struct<players: int, added: string>>"

SCORES = ", ".join(
    ["isSpam boolean"] + [f"{p} int" for p in PILLARS] + [f"{q} boolean" for q in QUALITY_FLAGS]
)

REVIEWS = (
    "app_id long, recommendationid string, review string, language string, timestamp_updated int, "
    "steam_purchase boolean, received_for_free boolean, voted_up boolean, weighted_vote_score double, "
    "playtime_at_review int, primarily_steam_deck boolean, has_hardware_info boolean, "
    + ", ".join(f"{h} string" for h in HARDWARE) + ", " + SCORES
)
DAILY_KPIS = (
    "app_id long, date date, mean_concurrent double, median_concurrent double, "
    "peak_concurrent int, min_concurrent int, pct_change double, trend string"
)
MINING_RUNS = (
    "app_id long, run_id string, timestamp timestamp, window_size_days int, total_reviews int, "
    "min_support double, min_confidence double, min_lift double, deduplicate_mode string"
)
ASSOCIATION_RULES = (
    "app_id long, rule_id string, run_id string, antecedents string, consequents string, "
    + ", ".join(f"{m} double" for m in RULE_METRICS)
)
HYPERPARAMETER_TUNING = (
    "app_id long, tuning_id string, tier_size int, dataset_size_at_tuning int, timestamp timestamp, "
    "params string, score double, mape_multistep_pct double, mape_1step_pct double, "
    "mape_multistep_std double, n_trials int, n_folds int"
)

TABLES = {
    "reviews": REVIEWS,
    "daily_kpis": DAILY_KPIS,
    "mining_runs": MINING_RUNS,
    "association_rules": ASSOCIATION_RULES,
    "hyperparameter_tuning": HYPERPARAMETER_TUNING,
}
# The key of a stored row, within its app.
KEYS = {
    "reviews": ["recommendationid"],
    "daily_kpis": ["date"],
    "mining_runs": ["run_id"],
    "association_rules": ["rule_id"],
    "hyperparameter_tuning": ["tier_size"],
}
