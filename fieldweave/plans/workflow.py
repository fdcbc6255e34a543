"""Events and their tasks: rows, briefs, tickets, cards and task lists.

Task names and day offsets of the templates are ours: the planning documents give the number of tasks
in each phase only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.functions.dates import iso_utc, moment
from fieldweave.functions.values import first_given, joined, leading_int, text_of
from fieldweave.operators.rows import kept_once
from fieldweave.sources.tables import Versions

EVENT = (
    "id string, name string, extName string, owner string, support string, date string, time string, location string, type string, status string, "
    "categories array<string>, audiences array<string>, marketing array<string>, collab string, collabNotes string, goals string, attendance string, "
    "metrics string, description string, eventbrite string, vendors string, facilities string, supplies string, equipment string, compost string, "
    "mulch string, expenses string, ros string, access string"
)
TASK = "title string, evName string, phase string, assignee string, due string, evDate string"

#: Tasks by event type and phase, and the phase's offset in days.
PHASES = {"Immediate": None, "1 Month": -30, "2 Weeks": -14, "1 Week": -7, "Day Of": 0, "Day After": 1}
TEMPLATES = {
    "Field Trip": (4, 1, 2, 3, 3, 4),
    "Private Volunteer": (5, 0, 2, 3, 2, 4),
    "Public Volunteer": (5, 3, 1, 4, 2, 4),
    "Public Program": (2, 3, 2, 1, 2, 1),
}


def is_kind(column: str, *words: str) -> Column:
    """Whether the type contains a word; a missing type contains none."""
    found = F.lit(False)
    for word in words:
        found = found | text_of(column).contains(word)
    return found


def tracker_row(events: DataFrame) -> DataFrame:
    """The 21 cells of an event's tracker row, as c01 to c21."""
    return events.select(*tracker_cells())


def tracker_cells() -> list[Column]:
    public = is_kind("type", "Public")
    empty, no = F.lit(""), F.lit(False)
    cells = [
        F.col("name"), F.col("owner"), F.col("date"), text_of("time"), text_of("location"), joined(F.col("categories"), ", "), F.col("type"),
        text_of("collab"), text_of("collabNotes"), F.when(public, "").otherwise("N/A (not a public event)"), F.when(public, "").otherwise("N/A"),
        empty, F.when(public, "").otherwise("N/A"), no, no, empty, no, no, no, empty, empty,
    ]
    return [c.alias(f"c{i:02d}") for i, c in enumerate(cells, 1)]


TRACKER = "id string, " + ", ".join(f"c{i:02d} {'boolean' if i in (14, 15, 17, 18, 19) else 'string'}" for i in range(1, 22))


def append_tracker_rows(store: Versions, events: DataFrame) -> int:
    """Append the tracker rows of events that the tracker (a Versions of TRACKER by id) does not have yet, one for each id; its number then. Events without an id are left out."""
    rows = kept_once(events.select("id", F.struct(*events.columns).alias("e")), ["id"], [F.to_json("e")]).select("e.*")
    cells = rows.select("id", *tracker_cells())
    return store.update_keys(lambda there: cells.join(there.select("id"), "id", "left_anti"))


def brief_fields() -> list[tuple[str, str, Column]]:
    """Section, label and value of an event's brief."""
    known = lambda c: F.coalesce(first_given(c), F.lit("TBD"))
    listed = lambda c: known(joined(F.col(c), ", "))
    shape = F.when(is_kind("type", "Virtual"), "Virtual").otherwise("In-person")
    partner = F.when(F.col("collab") == "Other Organization", known("collabNotes")).otherwise("N/A")
    client = F.when(is_kind("type", "Private", "School"), known("collabNotes")).otherwise("N/A")
    return [
        ("", "Status", F.upper(F.coalesce(first_given("status"), F.lit("confirmed")))),
        ("EVENT OVERVIEW", "Event Name (Internal)", known("name")), ("EVENT OVERVIEW", "Event Lead", known("owner")), ("EVENT OVERVIEW", "On-Site Support", known("support")),
        ("EVENT OVERVIEW", "Program Category", listed("categories")), ("EVENT OVERVIEW", "Format", shape), ("EVENT OVERVIEW", "Date", known("date")), ("EVENT OVERVIEW", "Time", known("time")),
        ("EVENT OVERVIEW", "Location/Venue", known("location")), ("EVENT OVERVIEW", "Partner/s", partner), ("EVENT OVERVIEW", "Client/s", client), ("EVENT OVERVIEW", "Primary Audience", listed("audiences")),
        ("IMPACT", "Goals", known("goals")), ("IMPACT", "Expected Attendance", known("attendance")), ("IMPACT", "Success Metrics", known("metrics")),
        ("COMMS", "Event Name (External)", F.coalesce(first_given("extName", "name"), F.lit("TBD"))), ("COMMS", "Description", known("description")),
        ("COMMS", "Marketing Channels", listed("marketing")), ("COMMS", "Eventbrite", known("eventbrite")),
        ("LOGISTICS", "Vendors", known("vendors")), ("LOGISTICS", "Facilities", known("facilities")), ("LOGISTICS", "Supplies", known("supplies")), ("LOGISTICS", "Equipment", known("equipment")),
        ("LOGISTICS", "Compost", known("compost")), ("LOGISTICS", "Mulch", known("mulch")), ("LOGISTICS", "Expenses", F.coalesce(first_given("expenses"), F.lit("NO"))),
        ("RUN OF SHOW", "", known("ros")), ("ACCESS NOTES", "", known("access")),
    ]


def event_brief(events: DataFrame) -> DataFrame:
    """id, position, section, label and value: a row for each field of each event's brief."""
    fields = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(s).alias("section"), F.lit(n).alias("label"), v.alias("value")) for i, (s, n, v) in enumerate(brief_fields())])
    return events.select("id", F.explode(fields).alias("f")).select("id", "f.*")


def ticket(events: DataFrame, zone: str = "America/New_York", hours: int = 2, capacity: int = 50) -> DataFrame:
    """What a ticketing service is told of an event."""
    start = moment(F.col("date"), F.col("time"), zone)
    return events.select(
        "id",
        first_given("extName", "name").alias("name"),
        F.coalesce(first_given("description"), F.concat(F.lit("Join us for "), text_of("name"))).alias("description"),
        iso_utc(start).alias("start"),
        iso_utc(start + F.make_dt_interval(hours=F.lit(hours))).alias("end"),
        is_kind("type", "Virtual").alias("online"),
        leading_int(F.col("attendance"), capacity).alias("capacity"),
    )


def is_ticketed() -> Column:
    return is_kind("type", "Public", "Workshop")


def event_card(events: DataFrame) -> DataFrame:
    """Fields of the chat card that announces an event."""
    who = F.coalesce(first_given("owner"), F.lit("Unassigned"))
    return events.select(
        "id",
        F.concat(F.lit("New event assigned to "), who).alias("message"),
        F.col("name").alias("title"),
        F.concat(F.upper(F.coalesce(first_given("status"), F.lit("confirmed"))), F.lit(" · Owner: "), who).alias("subtitle"),
        F.concat(text_of("date"), F.coalesce(F.concat(F.lit(" · "), first_given("time")), F.lit(""))).alias("when"),
        F.coalesce(first_given("location"), F.lit("TBD")).alias("where"),
        text_of("type").alias("type"),
        F.coalesce(first_given("attendance"), F.lit("TBD")).alias("attendance"),
    )


def payload(rows: DataFrame, key: str = "id") -> DataFrame:
    """key and payload: the other columns as JSON, as a service is sent them."""
    return rows.select(key, F.to_json(F.struct(*[c for c in rows.columns if c != key])).alias("payload"))


def task_titles(tasks: DataFrame, tag: str = "") -> DataFrame:
    """Title, description and due day of tasks that have one."""
    title = F.concat(F.lit(f"[{tag}] " if tag else ""), text_of("title"), F.lit(" — "), text_of("evName"))
    told = F.concat(F.lit("Event: "), text_of("evName"), F.lit("\nPhase: "), text_of("phase"), F.lit("\nAssignee: "), text_of("assignee"), F.lit("\nEvent date: "), text_of("evDate"))
    return tasks.where(first_given("due").isNotNull()).select(title.alias("title"), told.alias("description"), F.col("due"))


def task_filter(tasks: DataFrame, assignee: str | None = None, due_from=None, due_to=None, phase: str | None = None) -> DataFrame:
    """Tasks of a person, a span of days, a phase; what is not given does not restrict."""
    due = F.col("due").try_cast("date")
    for wanted, condition in ((assignee, F.col("assignee") == assignee), (phase, F.col("phase") == phase), (due_from, due >= F.lit(due_from)), (due_to, due <= F.lit(due_to))):
        if wanted is not None:
            tasks = tasks.where(condition)
    return tasks


def template_rows(spark: SparkSession) -> DataFrame:
    """type, phase, number and day offset of each template task (63 rows); Immediate has no offset from the event's day."""
    rows = [(kind, phase, n, PHASES[phase]) for kind, counts in TEMPLATES.items() for phase, count in zip(PHASES, counts) for n in range(1, count + 1)]
    return spark.createDataFrame(rows, "type string, phase string, task int, day_offset int")


def expand_tasks(events: DataFrame, date: Column, kind: Column, created: Column, keep: list[str]) -> DataFrame:
    """A row for each template task of each event, with its due day: created for Immediate, else so many days from the event."""
    typed = events.withColumn("__date", date).withColumn("__type", kind).withColumn("__created", created)
    tasks = F.broadcast(template_rows(events.sparkSession))
    met = typed.join(tasks, F.col("__type") == tasks["type"])
    due = F.when(F.col("day_offset").isNull(), F.col("__created")).otherwise(F.date_add("__date", F.coalesce("day_offset", F.lit(0))))
    return met.select(*keep, tasks["type"].alias("type"), "phase", "task", due.alias("due"))
