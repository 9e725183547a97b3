"""Logical tables: explicit schemas and the defaults declared for absent values."""

from __future__ import annotations

from pyspark.sql import functions as F

# JSON documents of unknown shape travel as text and are opened with variant functions.
TABLES = {
    "app_state": (
        "user_id string, state string, version bigint, device string, "
        "updated_at timestamp, created_at timestamp"
    ),
    "subscriptions": (
        "user_id string, status string, plan string, expires_at timestamp, provider string, "
        "provider_ref string, updated_at timestamp"
    ),
    "award_entrants": (
        "user_id string, ref string, name string, school string, region string, phone string, "
        "email string, updated_at timestamp"
    ),
    "award_entries": (
        "ref string, html string, replaced int, masked int, image_count int, "
        "suspects array<string>, stats string, status string, app_version string, "
        "submitted_at timestamp"
    ),
    "users": "id string, email string, created_at timestamp",
}

# Declared column defaults.
DEFAULTS = {
    "app_state": {
        "state": lambda: F.lit("{}"),
        "version": lambda: F.lit(1).cast("long"),
        "updated_at": F.current_timestamp,
        "created_at": F.current_timestamp,
    },
    "subscriptions": {"status": lambda: F.lit("free"), "updated_at": F.current_timestamp},
    "award_entrants": {"updated_at": F.current_timestamp},
    "award_entries": {
        "replaced": lambda: F.lit(0),
        "masked": lambda: F.lit(0),
        "image_count": lambda: F.lit(0),
        "suspects": lambda: F.array().cast("array<string>"),
        "stats": lambda: F.lit("{}"),
        "status": lambda: F.lit("received"),
        "submitted_at": F.current_timestamp,
    },
    "users": {},
}

# Permitted states.
SUBSCRIPTION_STATUS = ["free", "active", "expired", "cancelled"]
ENTRY_STATUS = ["received", "needs_review", "disqualified", "judged"]

DOMAINS = {
    "app_state": {
        "user_id": {"required": True},
        "state": {"required": True},
        "version": {"required": True},
        "updated_at": {"required": True},
        "created_at": {"required": True},
    },
    "subscriptions": {
        "user_id": {"required": True},
        "status": {"required": True, "values": SUBSCRIPTION_STATUS},
        "updated_at": {"required": True},
    },
    "award_entrants": {
        "user_id": {"required": True},
        "ref": {"required": True},
        "updated_at": {"required": True},
    },
    "award_entries": {
        "ref": {"required": True},
        "html": {"required": True},
        "replaced": {"required": True},
        "masked": {"required": True},
        "image_count": {"required": True},
        "suspects": {"required": True},
        "stats": {"required": True},
        "status": {"required": True, "values": ENTRY_STATUS},
        "submitted_at": {"required": True},
    },
}

KEYS = {
    "app_state": {"unique": [["user_id"]], "foreign": [(["user_id"], "users", ["id"])]},
    "subscriptions": {"unique": [["user_id"]], "foreign": [(["user_id"], "users", ["id"])]},
    "award_entrants": {
        "unique": [["user_id"], ["ref"]],
        "foreign": [(["user_id"], "users", ["id"])],
    },
    "award_entries": {"unique": [["ref"]], "foreign": [(["ref"], "award_entrants", ["ref"])]},
}

# Columns that lead to a person; none of them may reach a judge.
IDENTITY_COLUMNS = ["user_id", "name", "school", "region", "phone", "email"]
JUDGING_COLUMNS = [
    "ref", "html", "stats", "image_count", "replaced", "masked", "status", "submitted_at",
]
