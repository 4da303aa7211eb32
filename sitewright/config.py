"""Thresholds and small fixed vocabularies used by several operators.

The values in this file are fixed values: results depend on them exactly.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    title_min: int = 20
    title_max: int = 65
    description_min: int = 70
    description_max: int = 160
    ttfb_ms: int = 800
    html_bytes: int = 250 * 1024
    scripts_per_page: int = 25
    styles_per_page: int = 15
    script_bytes: int = 1024 * 1024
    style_bytes: int = 300 * 1024
    image_bytes: int = 300 * 1024
    rendered_word_ratio: float = 1.5
    lab_score_warning: float = 0.7
    lab_score_error: float = 0.5
    lab_seo_warning: float = 0.8
    lcp_warning_ms: int = 2500
    lcp_error_ms: int = 4000
    tbt_warning_ms: int = 200
    tbt_error_ms: int = 600
    console_errors_warning: int = 1
    hsts_min_age: int = 60 * 60 * 24 * 180
    compression_min_bytes: int = 4 * 1024
    sample_size: int = 10


THRESHOLDS = Thresholds()

# fixed values: query keys that never identify a page
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "msclkid",
)

# fixed values: file extensions that are not pages
NON_PAGE_EXTENSIONS = (
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".rar", ".7z", ".gz", ".tar",
    ".jpg", ".jpeg", ".png", ".gif", ".webp", ".avif", ".svg", ".mp4", ".mov", ".avi", ".wmv", ".mp3",
    ".wav", ".ogg", ".css", ".js", ".json", ".xml", ".txt", ".woff", ".woff2", ".ttf", ".eot",
)
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".avif", ".svg")
FONT_EXTENSIONS = (".woff", ".woff2", ".ttf", ".eot")

# fixed values: multi-label public suffixes known to the apex rule; every other host uses its last two labels
MULTI_LABEL_SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp",
    "or.jp", "com.br", "com.mx", "com.ar", "com.tr", "com.cn", "com.hk", "com.sg", "co.in", "co.kr", "co.za",
    "co.at", "or.at",
)

# fixed values: crawlers whose access the policy operators evaluate
AI_BOTS = (
    "GPTBot", "OAI-SearchBot", "ChatGPT-User", "ClaudeBot", "Claude-Web", "PerplexityBot", "Google-Extended",
    "CCBot", "Applebot", "Bytespider",
)

# fixed values: evaluation states
STATE_PASS = "pass"
STATE_FAIL = "fail"
STATE_NOT_APPLICABLE = "not_applicable"
STATE_INSUFFICIENT = "insufficient_evidence"
STATE_NOT_EXECUTED = "not_executed"
STATE_TECHNICAL = "technical_error"
