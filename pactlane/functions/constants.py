"""Fixed values of the contract format.

Everything in this file must equal the published format for results to agree:
enumerations, rule rows, patterns, alias words and message wording.
"""

from __future__ import annotations

# ---- fixed values: enumerations -------------------------------------------------
SPLITS = ("train", "dev", "test")
TASK_TYPES = ("blocked", "clarify", "extract", "form_fill", "navigate", "search")
ROUTES = ("clarify", "deny", "extract_page", "fill_form", "open_url", "search_web")
LANGUAGE = "zh-CN"
CONTRACT_VERSION = "v1"

# ---- fixed values: contract fields, in the order they are constructed ------------
CONTRACT_FIELDS = (
    "task_type",
    "route",
    "safety",
    "confirmation_required",
    "slots",
    "normalized_command",
    "language",
    "contract_version",
)
CORE_FIELDS = CONTRACT_FIELDS[:5]
DERIVED_FIELDS = CONTRACT_FIELDS[5:]
SAFETY_FIELDS = ("allow", "reason")

# ---- fixed values: the nine comparable field paths --------------------------------
FIELD_PATHS = (
    "task_type",
    "route",
    "safety.allow",
    "safety.reason",
    "confirmation_required",
    "slots",
    "normalized_command",
    "language",
    "contract_version",
)

# ---- fixed values: semantic rule per task type ------------------------------------
# task_type -> (route, safety.allow, safety.reason, allowed confirmations, required slot)
TASK_RULES = {
    "search": ("search_web", True, "public_readonly", (False,), "query"),
    "navigate": ("open_url", True, "public_readonly", (False,), "url"),
    "form_fill": ("fill_form", True, "requires_confirmation", (True,), "field"),
    "extract": ("extract_page", True, "public_readonly", (False,), "target"),
    "clarify": ("clarify", True, "ambiguous_request", (True,), "ambiguity"),
    "blocked": ("deny", False, "unsafe_payment", (False, True), "reason"),
}

# ---- fixed values: rejection categories, generation order, and their slice -------
REJECTION_SLICE = {
    "wrong_task_type": "task_type",
    "wrong_route": "route",
    "unsafe_allowance": "safety",
    "missing_confirmation": "confirmation",
    "missing_slot": "slot",
    "wrong_slot": "slot",
    "decomposed_search_slots": "slot",
    "extract_search_fallback": "task_type",
    "extract_query_slot": "slot",
    "extract_generic_price_wording": "slot",
    "extract_listed_price_wording": "slot",
    "extract_extra_particle_wording": "normalized_command",
    "clarify_action_drift": "task_type",
    "blocked_payment_action_drift": "safety",
    "form_confirmation_drift": "confirmation",
    "navigate_canonical_url_drift": "normalized_command",
    "underspecified_request": "underspecified",
    "malformed_schema": "schema",
}
REJECTION_CATEGORIES = tuple(REJECTION_SLICE)
PREFERENCE_SLICES = (
    "task_type",
    "route",
    "safety",
    "confirmation",
    "slot",
    "normalized_command",
    "schema",
    "underspecified",
)
TASK_TYPE_SWAP = {
    "search": "navigate",
    "navigate": "search",
    "form_fill": "extract",
    "extract": "form_fill",
    "clarify": "search",
    "blocked": "navigate",
}
PRICE_TARGET = "商品价格"
PRICE_COMMAND = "提取页面商品价格"
PAYMENT_REASON_SLOT = "payment_requires_user_control"
SEARCH_PREFIX = "搜索"

# ---- fixed values: public-safety patterns (Java dialect, Unicode classes on) ------
PRIVATE_PATH = r"""(?U)(/Users/[^\s"')]+|/root/[^\s"')]+|/tmp/[^\s"')]+|/mnt/data/[^\s"')]+)"""
SECRET = (
    r"(?U)(sk-[A-Za-z0-9]{16,}|AKIA[0-9A-Z]{16}|"
    r"(?iu:(?:api[_-]?key|secret|token)\s*[:=]\s*[A-Za-z0-9_./+=-]{8,}))"
)
PRIVATE_IP = (
    r"(?U)\b(10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[0-1])\.\d{1,3}\.\d{1,3}|"
    r"192\.168\.\d{1,3}\.\d{1,3})\b"
)
SSH_DETAIL = (
    r"(?iuU)(\bssh\s+[^@\s]+@|ssh-rsa|BEGIN OPENSSH PRIVATE KEY|"
    r"^\s*HostName\s+\S+|^\s*IdentityFile\s+\S+)"
)
MODEL_ARTIFACT_SUFFIXES = (".safetensors", ".ckpt", ".pt", ".bin")
PRIVATE_ARTIFACT_PARTS = ("adapter", "adapters", "cache", "checkpoints", "runs", "logs")
SKIPPED_DIRECTORY_PARTS = (".git", "__pycache__", ".pytest_cache", ".ruff_cache", ".mypy_cache", "local-private")

# ---- fixed values: slot normalisation --------------------------------------------
SLOT_SEPARATORS = r"""(?U)[\s\-_.,!?:;，。！？：；、（）()\[\]{}"'`]+"""
SLOT_KEY_ALIASES = {
    "keyword": "query",
    "keywords": "query",
    "searchterm": "query",
    "searchterms": "query",
    "search_term": "query",
    "q": "query",
}
SLOT_VALUE_ALIASES = {
    "open": "打开",
    "navigate": "打开",
    "go": "打开",
    "visit": "打开",
    "search": "搜索",
    "query": "搜索",
    "find": "搜索",
}
SLOT_PATH_ALIASES = {
    "query": ("search_text", "keyword", "keywords", "q"),
    "url": ("link", "uri", "website", "site"),
    "field": ("field_name", "form_field", "target_field"),
    "value": ("field_value", "input_value"),
    "target": ("extract_target", "content", "attribute"),
    "ambiguity": ("target", "clarification_target", "missing_info"),
    "reason": ("rationale", "deny_reason", "safety_reason"),
}
TRUE_WORDS = ("true", "yes", "y", "1", "是", "需要", "确认", "开启", "打开")
FALSE_WORDS = ("false", "no", "n", "0", "否", "不需要", "无需", "关闭")

# ---- fixed values: held-out sources and ancestry ----------------------------------
FORBIDDEN_SOURCES = ("train", "training", "remediation", "analysis")
ANCESTOR_KEYS = (
    "row_id",
    "id",
    "source_id",
    "source_case_id",
    "source_candidate_id",
    "source_row_id",
    "category",
    "source_category",
    "provenance_category",
)
ANCESTOR_PROVENANCE_KEYS = ("source_id", "source_case_id", "source_candidate_id", "source_row_id")
LINEAGE_KEYS = ANCESTOR_PROVENANCE_KEYS + ("source_family_id", "candidate_family")
LINEAGE_LIST_KEYS = ("source_row_ids", "source_ids", "derived_from")
FAMILY_KEYS = ("semantic_family_id", "family_id", "candidate_family", "source_family_id")
MANIFEST_HASH_FIELDS = ("lockbox_hash", "lockbox_sha256", "dataset_sha256")

# ---- fixed values: evaluation vocabularies ------------------------------------------
FAILURE_SLICES = ("schema", "semantic", "task_type", "route", "safety", "confirmation", "slot", "unknown")
RESIDUAL_FAMILIES = (
    "route",
    "task_type",
    "normalized_command",
    "slot_key",
    "slot_value",
    "missing_slot",
    "extra_slot",
    "risk_level",
    "confirmation",
    "success_criteria",
    "allowed_actions",
    "refusal_or_clarify",
    "extra_field",
    "missing_field",
    "invalid_output",
)
GOLD_FRAGMENTS = ("gold", "correct", "accuracy", "score", "evaluator")

# ---- fixed values: span verification -------------------------------------------------
EXACT_UNIQUE = "VERIFIED_EXACT_UNIQUE"
NORMALIZED_UNIQUE = "VERIFIED_NORMALIZED_UNIQUE"
AMBIGUOUS = "AMBIGUOUS_MULTIPLE_MATCHES"
COLLISION = "AMBIGUOUS_NORMALIZATION_COLLISION"
NOT_FOUND = "NOT_FOUND"
UNSUPPORTED = "UNSUPPORTED_VALUE_TYPE"
OUT_OF_SCOPE = "OUT_OF_SCOPE"
INVALID_INPUT = "INVALID_INPUT"
ENABLED_SCOPES = ("search:search_web:query", "form_fill:fill_form:field", "extract:extract_page:target")
