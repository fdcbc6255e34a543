"""Schemas of landed files and tables."""

from __future__ import annotations

#: An answer as the API gives it; every level may be null, ids and dates may be numbers or texts.
ERRORS = "array<struct<message: string>>"
ENVELOPE = f"data struct<activityReports: array<struct<{', '.join(p.replace(' ', ': ', 1) for p in ['id string', 'date string', 'treeId string', 'duration string', 'stewardshipActivities array<string>'])}, tree: struct<id: string, closestAddress: string, species: struct<commonName: string>>>>>, errors {ERRORS}"

#: Columns of the flat tables, all text on disk.
TABLES = {
    "activities": ["id", "date", "treeId", "species", "address", "activitiesDone", "durationMinutes", "scrapedAt"],
    "trees": ["treeId", "latitude", "longitude", "address", "species"],
    "Reservations": ["id", "treeId", "name", "date", "lat", "lng", "species", "address", "health", "dbh", "planted", "priority", "nta", "note", "createdAt"],
    "TreeGuards": ["treeId", "markedBy", "guardType", "markedAt", "note"],
    "CareNeeded": ["treeId", "careNeeds", "markedAt", "markedBy"],
    "CommunityStewardship": ["treeId", "caretaker", "activities", "markedAt"],
    "MissingTrees": ["treeId", "type", "note", "markedAt"],
}


def ddl(table: str) -> str:
    return ", ".join(f"`{c}` string" for c in TABLES[table])
