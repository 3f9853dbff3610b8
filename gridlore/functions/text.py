"""Text, number, time and label columns of the console's pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH, ELLIPSIS = "—", "…"


def truthy(c: Column) -> Column:
    """Null and the empty string count as absent."""
    return F.coalesce(c != "", F.lit(False))


def absent_to(c: Column, default: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), default)


def not_equal(c: Column, value: object) -> Column:
    """Null differs from every value."""
    return ~c.eqNullSafe(F.lit(value))


def strip(c: Column) -> Column:
    """Without any Unicode white space at both ends; trim() takes blanks alone."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalise_space(c: Column) -> Column:
    """Runs of any Unicode white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def truncate(c: Column, most: int) -> Column:
    """Texts over `most` code points keep the first most - 3 and an ellipsis."""
    return F.when(F.char_length(c) > most, F.concat(F.left(c, F.lit(most - 3)), F.lit(ELLIPSIS))).otherwise(c)


def thread_title(message: Column) -> Column:
    return truncate(normalise_space(message), 80)


def display_title(title: Column, thread_id: Column) -> Column:
    """Trimmed title, or the thread's number where there is none."""
    return absent_to(strip(title), F.concat(F.lit("Conversation #"), thread_id.cast("string")))


def unix_lines(c: Column) -> Column:
    return F.replace(c, F.lit("\r\n"), F.lit("\n"))


def history_line(role: Column, content: Column, most: int = 600) -> Column:
    """`User: ...` for the user, `Assistant: ...` for every other role."""
    label = F.when(role == "user", "User").otherwise("Assistant")
    return F.concat(label, F.lit(": "), truncate(unix_lines(strip(F.coalesce(content, F.lit("")))), most))


def humanize_key(key: Column) -> Column:
    """`_` to space, camelCase split, each word's first letter in upper case and the rest as it was."""
    spaced = F.regexp_replace(F.replace(F.coalesce(key, F.lit("")), F.lit("_"), F.lit(" ")), "([a-z])([A-Z])", "$1 $2")
    pieces = F.regexp_extract_all(spaced, F.lit(r"(\w+|\W+)"), 1)
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, F.lit(2), F.char_length(p)))), "")


def short_name(name: Column, mark: str = "·") -> Column:
    return strip(F.split_part(name, F.lit(mark), F.lit(1)))


def joined(values: Column, by: str = ", ") -> Column:
    return F.array_join(values, by, "")


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def cell_text(value: Column) -> Column:
    """How a variant is shown in a table cell: nothing, plain lists, or JSON."""
    kind = F.schema_of_variant(value)
    plain = F.array_join(F.variant_get(value, "$", "array<string>"), ", ", "")
    return (
        F.when(value.isNull() | kind.isin("VOID", "ARRAY<VOID>"), DASH)
        .when(kind.startswith("ARRAY<OBJECT") | kind.startswith("OBJECT"), F.to_json(value))
        .when(kind.startswith("ARRAY"), plain)
        .otherwise(F.variant_get(value, "$", "string"))
    )


def round_half_up(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """Rounded percentage; 0 where there is nothing to divide by."""
    return F.coalesce(round_half_up(F.try_divide(part * 100.0, F.nullif(whole, F.lit(0)))), F.lit(0).cast("long"))


def percent_text(x: Column, digits: int = 0) -> Column:
    return F.when(x.isNull() | F.isnan(x), DASH).otherwise(F.concat(F.replace(F.format_number(F.round(x * 100, digits), digits), F.lit(","), F.lit("")), F.lit("%")))


def unit_clamp(x: Column) -> Column:
    """Into 0..1; null and NaN are 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))))


def score_band(x: Column) -> Column:
    p = unit_clamp(x)
    return F.when(p >= 0.85, "red").when(p >= 0.7, "rose").when(p >= 0.5, "amber").otherwise("emerald")


def bar_width(count: Column, most: Column) -> Column:
    return F.greatest(F.lit(4).cast("long"), round_half_up(count * 100.0 / F.greatest(most, F.lit(1))))


def relative_time(ts: Column, now: Column) -> Column:
    """`5m ago`, `in 2h`; each unit is rounded from the one before. Null stays a dash."""
    diff = F.unix_millis(now.cast("timestamp")) - F.unix_millis(ts.cast("timestamp"))
    s = round_half_up(F.abs(diff) / 1000)
    m = round_half_up(s / 60)
    h = round_half_up(m / 60)
    d = round_half_up(h / 24)
    amount = F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(m < 60, F.concat(m.cast("string"), F.lit("m"))).when(h < 24, F.concat(h.cast("string"), F.lit("h"))).otherwise(F.concat(d.cast("string"), F.lit("d")))
    return F.when(ts.isNull(), DASH).when(diff < 0, F.concat(F.lit("in "), amount)).otherwise(F.concat(amount, F.lit(" ago")))


def parse_time(c: Column) -> Column:
    """ISO text to timestamp; anything else is null."""
    return F.try_to_timestamp(c)


def date_time(ts: Column, pattern: str = "MMM dd, HH:mm:ss") -> Column:
    return F.coalesce(F.date_format(ts, pattern), F.lit(DASH))


def labelled(key: Column, labels: dict[str, str], default: Column | None = None) -> Column:
    """Label of a key; unknown keys show themselves, absent ones a dash."""
    mapping = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    other = absent_to(key, F.lit(DASH)) if default is None else default
    return F.coalesce(F.try_element_at(mapping, F.coalesce(key, F.lit(""))), other)


# Labels and tones.
STATUS_LABELS = {"active": "Active", "contained": "Contained", "monitoring": "Monitoring", "proposed": "Proposed", "approved": "Approved", "implemented": "Implemented"}
STATUS_TONES = {"active": "red", "contained": "emerald", "monitoring": "amber", "proposed": "indigo", "approved": "violet", "implemented": "emerald"}
SEVERITY_TONES = {"critical": "red", "high": "rose", "medium": "amber", "low": "emerald"}
LEVEL_TONES = {"alert": "red", "warn": "amber", "info": "slate", "debug": "faint"}
TRIAGE_LABELS = {"escalate": "Escalate", "review": "Review", "monitor": "Monitor", "drop": "Drop"}
TRIAGE_TONES = {"escalate": "red", "review": "amber", "monitor": "sky", "drop": "slate"}
HEALTHY, DEGRADED = ("healthy", "connected", "green", "ok"), ("degraded", "yellow", "warming")


def tone(key: Column, tones: dict[str, str]) -> Column:
    return labelled(key, tones, F.lit("slate"))


def level_tone(level: Column) -> Column:
    """Tone of a log level; unknown and absent levels look like info."""
    return labelled(level, LEVEL_TONES, F.lit(LEVEL_TONES["info"]))


def health_tone(state: Column) -> Column:
    low = F.lower(F.coalesce(state.cast("string"), F.lit("")))
    return F.when(low.isin(*HEALTHY), "good").when(low.isin(*DEGRADED), "degraded").otherwise("other")


def asset_tone(status: Column) -> Column:
    return labelled(status, {"Operational": "green", "Maintenance": "yellow", "Decommissioned": "gray", "Offline": "red"}, F.lit("blue"))


def criticality_tone(criticality: Column) -> Column:
    return labelled(criticality, {"Critical": "red", "High": "orange", "Medium": "yellow", "Low": "green"}, F.lit("gray"))


def zone_layer(zone: Column) -> Column:
    """Layer of a zone name: the first rule that is contained in it, by case; no rule or no zone: L2."""
    # Layers and the zone names that mean them.
    rules = (("L0", "Level 0", "Process"), ("L1", "Level 1", "Basic Control"), ("L2", "Level 2", "Area Control"), ("L3", "Level 3", "Site Operations"), ("L4", "Level 4", "Enterprise"), ("DMZ", "DMZ", "DMZ"))
    out = F.lit("L2")
    for layer, a, b in reversed(rules):
        out = F.when(zone.contains(a) | zone.contains(b), layer).otherwise(out)
    return out
