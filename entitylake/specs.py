"""Entity descriptions. A new entity is a new record in ``ENTITIES``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EntitySpec:
    name: str
    envelope: str  # key below `_embedded` in a page
    event_noun: str  # suffix of its webhook event types
    aliases: tuple[str, ...] = ()
    key: str = "id"
    relations: tuple[str, ...] = ()  # expanded related entities inside a document


# Names and relation expansions of the CRM.
RELATIONS = ("catalog_elements", "leads", "customers")
ENTITIES = {
    spec.name: spec
    for spec in (
        EntitySpec("deals", "leads", "lead", aliases=("leads",), relations=RELATIONS),
        EntitySpec("contacts", "contacts", "contact", relations=RELATIONS),
        EntitySpec("companies", "companies", "company", relations=RELATIONS),
        EntitySpec("events", "events", "event"),
    )
}
# Document keys with a rule of their own.
LINKS = "_links"
CUSTOM_FIELDS = "custom_fields_values"
LINK_URL = "link_url"
EPOCH_FIELDS = ("created_at", "updated_at", "closest_task_at", "closed_at")
EMPTY_AS_BLANK = ("catalog_elements", "companies", "tags")
# Custom-field types by the way their values are read.
FIRST_VALUE_TYPES = ("select", "text", "numeric", "date", "datetime", "checkbox", "url")
# Webhook verbs.
EVENT_VERBS = ("add", "update", "delete")
DELETE_VERB = "delete"


def canonical_name(entity: str) -> str:
    """Collection of an entity name; unknown names stand for themselves."""
    for spec in ENTITIES.values():
        if entity in spec.aliases:
            return spec.name
    return entity


def canonical(entity: Column) -> Column:
    """``canonical_name`` for a column."""
    aliased = {alias: spec.name for spec in ENTITIES.values() for alias in spec.aliases}
    result = entity
    for alias, name in aliased.items():
        result = F.when(entity == alias, F.lit(name)).otherwise(result)
    return result
