"""Engine options from key=value text, with defaults, booleans and comma lists."""

from __future__ import annotations

from collections.abc import Mapping

TRUE = ("1", "true", "yes", "on")

# The names and defaults of the options.
DEFAULTS: dict[str, object] = {
    "data_dir": "/data", "api_token": "change-me", "base_path": "/", "llm_base_url": "http://ollama:11434", "llm_model": "qwen2.5:7b", "ocr_device": "cpu", "ocr_lite": True,
    "max_upload_mb": 20, "channel_secret": "", "channel_access_token": "", "login_channel_id": "", "app_url": "", "invite_codes": (), "session_hours": 720, "card_scope": "personal",
    "poll_seconds": 1, "search_limit": 5, "autorotate": True,
}


def load(given: Mapping[str, str]) -> dict[str, object]:
    """DEFAULTS with what is given, each in its default's type; unknown keys are ignored."""
    out = dict(DEFAULTS)
    for key, value in given.items():
        if key in DEFAULTS:
            kind = type(DEFAULTS[key])
            out[key] = value.strip().lower() in TRUE if kind is bool else tuple(x.strip() for x in value.split(",") if x.strip()) if kind is tuple else kind(value.strip())
    return out
