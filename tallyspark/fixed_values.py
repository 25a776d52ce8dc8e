"""Values that have to match the log format and the published price sheets.

They are data, not logic: change one only when the format itself changes.
"""

# --- fixed values: session logs -------------------------------------------
USAGE_LIMIT_ID = "codex"
USAGE_PROVIDER = "openai"
LINE_MARKERS = ('"session_meta"', '"turn_context"', '"token_count"', '"thread_settings_applied"')
UNCERTAIN_MARKERS = ('"token_count"', '"session_meta"')
COUNTER_FIELDS = ("input", "cached_input", "cache_write_input", "output", "reasoning_output", "total")
U64_MAX = 18446744073709551615

# --- fixed values: accounting ---------------------------------------------
CAPPED_PERCENT = 99.99
BALANCE_EPSILON = 1e-6
SHORT_CONTEXT_LIMIT = 272_000
USD_PER_CREDIT = 0.04

# --- fixed values: quota and alerts ---------------------------------------
SHORT_WINDOW_MAX_SECONDS = 24 * 3600
HEALTHY_MIN_REMAINING = 50.0
WARNING_MIN_REMAINING = 20.0
OVERFLOW_ALERT_CREDITS = 0.25
RESET_DRIFT_SHARE = 0.10
RESTORED_MAX_USED = 1.0
RESTORED_MIN_DROP = 5.0
MIN_BLIND_GAP_SECONDS = 15 * 60
GAP_RETRY_SECONDS = 6 * 3600

# --- fixed values: price sheets -------------------------------------------
PRICED_SECTIONS = {
    "Flagship models": "flagship",
    "Cyber models": "cyber",
    "Specialized models": "specialized",
}
UNPRICED_SECTIONS = (
    "GPT-Live sessions",
    "Realtime and audio generation models",
    "Image generation models",
    "Transcription models",
    "Fine-tuning models",
    "Fine-tuning",
    "Finetuning",
    "Video generation models",
    "Built-in tools",
)
TIER_HEADINGS = {
    "Standard": "standard",
    "Fast": "fast",
    "Ultrafast": "ultrafast",
    "Batch": "",
    "Flex": "",
}
TIER_HEADING_SUFFIX = " pricing data"
UNIT_LINE = "Prices per 1M tokens."
THRESHOLD_START = "Short context:"
THRESHOLD_COMPACT = "Shortcontext:≤272Kinputtokens.Longcontext:>272Kinputtokens."
UNPRICED_CATEGORIES = ("Embedding", "Moderation")
SHORT_COLUMNS = ("Short context input", "Short context cached input", "Short context output")
LONG_COLUMNS = ("Long context input", "Long context cached input", "Long context output")
PLAIN_COLUMNS = ("Input", "Cached input", "Output")

# --- fixed values: service tiers in logs ----------------------------------
TIER_ALIASES = {
    "default": "standard",
    "standard": "standard",
    "priority": "fast",
    "fast": "fast",
    "ultrafast": "ultrafast",
}

# --- fixed values: plan names ---------------------------------------------
PLAN_LABELS = {
    "free": "Free",
    "go": "Go",
    "plus": "Plus",
    "pro": "Pro",
    "prolite": "Pro Lite",
    "team": "Team",
    "self_serve_business_usage_based": "Business",
    "business": "Business",
    "ent26": "Enterprise",
    "enterprise_cbp_usage_based": "Enterprise",
    "enterprise": "Enterprise",
    "edu": "Edu",
    "unknown": "未知方案",
}
PLAN_CLASSES = {
    "free": "neutral",
    "go": "neutral",
    "plus": "plus",
    "pro": "pro",
    "prolite": "pro",
    "team": "business",
    "self_serve_business_usage_based": "business",
    "business": "business",
    "ent26": "enterprise",
    "enterprise_cbp_usage_based": "enterprise",
    "enterprise": "enterprise",
    "edu": "edu",
}

# Words of the report and alert texts.
WINDOW_UNITS = {"month": "月", "week": "周", "day": "天", "hour": "小时", "minute": "分钟"}
QUOTA_NAMES = {"short": "5h额度", "free": "月额度", "long": "周额度", "suffix": "额度"}
PERIOD_NAMES = {"free": "本月", "paid": "本周", "short": "本期", "prefix": "本"}
AGES = {"now": "刚刚更新", "minutes": "分钟前更新", "hours": "小时前更新", "days": "天前更新"}
RESET_TEXT = "窗口已重置，当前剩余 "
OVERFLOW_TEXTS = ("已扣 ", " credits（约 ", "）")
