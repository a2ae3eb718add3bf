"""Stored model replies: parse, merge chunks, normalise, choose an attempt."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pageledger.functions import patterns as P
from pageledger.functions.text import blank_to_null, filled, strip
from pageledger.operators.families import strip_fences

STRINGS = "array<string>"
#: Every value of a step keeps the type it has in the reply. Of a repeated name the last counts.
STEP_COLUMNS = ("step_name", "settings", "voltages_pn", "voltage_pp", "leds", "relay_status", "on_delay", "off_delay", "section_break")
STEP = f"struct<{','.join(f'{c}:variant' for c in STEP_COLUMNS)}>"
#: Steps stay JSON texts at first: one item that is no object must not cost the others.
STEP_REPLY = "struct<test_steps:array<string>,steps:array<string>,procedure:array<string>>"


def _none() -> Column:
    return F.array().cast(STRINGS)


def json_text(body: Column) -> Column:
    """From the first ``{`` to the last ``}``, without code fences."""
    return F.regexp_extract(strip_fences(body), r"(?s)\{.*\}", 0)


def parse_replies(replies: DataFrame, schema: str, body: str = "body") -> DataFrame:
    """The reply object in ``reply``; text after the first object is ignored, anything else gives NULL."""
    return replies.withColumn("reply", F.from_json(json_text(F.col(body)), schema))


def coalesce_chunks(replies: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(keys, variant, field, value): the first filled value of each field in chunk order.

    ``replies(keys, chunk_idx, body)`` hold ``{variant: {field: value}}``; variant names lose white space and case, and of two
    equal names in one reply the later counts.
    """
    outer = F.map_entries(F.from_json(json_text(F.col("body")), "map<string,string>"))
    named = replies.select(*keys, "chunk_idx", F.posexplode(outer).alias("pos", "e")).filter(F.startswith("e.value", F.lit("{")))
    name = F.upper(F.regexp_replace("e.key", r"\s+", ""))
    last = named.groupBy(*keys, "chunk_idx", name.alias("variant")).agg(F.max_by("e.value", "pos").alias("_fields"))
    inner = F.map_entries(F.from_json("_fields", "map<string,string>"))
    fields = last.select(*keys, "chunk_idx", "variant", F.explode(inner).alias("f")).filter(filled(F.col("f.value")))
    return fields.groupBy(*keys, "variant", F.col("f.key").alias("field")).agg(F.min_by("f.value", "chunk_idx").alias("value"))


def normalize_specs(raw: DataFrame, keys: Sequence[str] = ("doc_id", "variant")) -> DataFrame:
    """Long (keys, field, value) to one wide row: 18 text fields, the LED map and the DIP list."""
    pick = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    wide = raw.groupBy(*keys).agg(*[pick(f).alias(f) for f in (*P.SPEC_FIELDS, "led_indications", "dip_switches")])
    out = {f: F.nullif(blank_to_null(F.col(f)), F.lit("null")) for f in P.SPEC_FIELDS}
    leds = F.when(F.startswith("led_indications", F.lit("{")), F.from_json("led_indications", "map<string,string>"))
    dips = F.when(F.startswith("dip_switches", F.lit("[")), F.from_json("dip_switches", STRINGS))
    out["led_indications"] = F.coalesce(leds, F.create_map().cast("map<string,string>"))
    out["dip_switches"] = F.coalesce(dips, _none())
    return wide.withColumns(out)


def as_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def truthy(v: Column) -> Column:
    """Whether a JSON value is neither null, false, zero nor empty; NULL where there is no value."""
    kind, text = F.schema_of_variant(v), as_text(v)
    return (
        F.when(v.isNull(), None).when(kind == "VOID", False).when(kind == "BOOLEAN", text == "true").when(kind == "STRING", text != "")
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), ~text.isin("{}", "[]")).otherwise(text.cast("double") != 0)
    )


def _is_list(v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit("ARRAY"))


def _texts(v: Column, only_filled: bool = True) -> Column:
    """The items of a JSON list as texts, those that hold something; no other value is a list."""
    items = F.when(_is_list(v), F.try_variant_get(v, "$", "array<variant>"))
    items = F.filter(items, truthy) if only_filled else items
    return F.transform(items, as_text)


def explode_steps(replies: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ordered raw steps of each reply: the first filled list of ``test_steps``, ``steps``, ``procedure``.

    Items that are no objects, or whose name is not a text, are left out; the others keep their place. What a value is follows from its JSON type: lists
    are lists, a phase voltage may be one text, a section break is anything that is neither null nor false, zero or empty.
    """
    listed = lambda n: F.when(F.size(f"reply.{n}") > 0, F.col(f"reply.{n}"))
    parsed = parse_replies(replies, STEP_REPLY)
    steps = F.coalesce(listed("test_steps"), listed("steps"), listed("procedure"))
    items = parsed.select(*keys, F.posexplode(steps).alias("pos", "item")).filter(F.startswith("item", F.lit("{")))
    read = items.select(*keys, (F.col("pos") + 1).alias("step_idx"), F.from_json("item", STEP).alias("s"))
    read = read.filter((F.schema_of_variant("s.step_name") == "STRING") & filled(as_text(F.col("s.step_name"))))
    value = {c: F.col(f"s.{c}") for c in STEP_COLUMNS}
    one = F.when(F.schema_of_variant(value["voltage_pp"]) == "STRING", F.array(as_text(value["voltage_pp"])))
    out = {
        "step_name": as_text(value["step_name"]), "settings": _texts(value["settings"]), "voltages_pn": _texts(value["voltages_pn"], only_filled=False),
        "voltage_pp": F.coalesce(_texts(value["voltage_pp"]), one), "leds": _texts(value["leds"]),
        **{c: F.when(truthy(value[c]), as_text(value[c])) for c in ("relay_status", "on_delay", "off_delay")}, "section_break": truthy(value["section_break"]),
    }
    return read.select(*keys, "step_idx", *[c.alias(n) for n, c in out.items()])


def round_voltage(v: Column) -> Column:
    """"RN : 239.96" to one decimal without a trailing .0, phase-phase labels down to a whole number."""
    label = strip(F.substring_index(v, " : ", 1))
    number = strip(F.regexp_extract(v, r"(?s)^.*? : (.*)$", 1)).try_cast("double")
    one = F.bround(number, 1)
    text = F.when(F.upper(label).isin("RY", "YB", "BR"), F.floor(number).cast("string")).when(
        one == F.floor(one), F.floor(one).cast("string")
    ).otherwise(one.cast("string"))
    return F.when(F.contains(v, F.lit(" : ")) & number.isNotNull(), F.concat(label, F.lit(" : "), text)).otherwise(v)


def normalize_step(steps: DataFrame) -> DataFrame:
    """Raw steps to the house form: names, setting units, rounded voltages, delays."""
    name = strip(F.col("step_name"))
    lower = F.lower(name)
    clean = lambda c: F.filter(F.transform(F.coalesce(c, _none()), strip), lambda x: x != "")
    percent = lambda s: F.regexp_replace(F.regexp_replace(s, r"(\d{2,})\s*%", "$1%"), r"(?<!\d)(\d)\s*%", "$1 %")
    settings = F.transform(clean("settings"), lambda s: F.when(s.rlike(r"(?i)^P[123]\s*="), percent(s)).otherwise(s))
    swap = lambda s, a, b: F.replace(s, F.lit(a), F.lit(b))
    to_sec = F.transform(settings, lambda s: swap(swap(s, "P2 = 0 MIN", "P2 = 0 SEC"), "P3 = 0 MIN", "P3 = 0 SEC"))
    to_min = F.transform(settings, lambda s: swap(swap(s, "P3 = 0 SEC", "P3 = 0 MIN"), "P3 = 0SEC", "P3 = 0 MIN"))
    minutes = F.exists(settings, lambda s: F.contains(s, F.lit("MIN"))) & F.exists(settings, lambda s: s.rlike("P3 = 0 ?SEC"))
    pp = F.col("voltage_pp")
    if dict(steps.dtypes)["voltage_pp"] == STRINGS:
        pp_list = F.coalesce(pp, _none())
    else:  # one text, or a list kept as text
        pp_list = F.when(F.startswith(pp, F.lit("[")), F.from_json(pp, STRINGS)).when(filled(strip(pp)), F.array(pp)).otherwise(_none())
    off = strip(F.col("off_delay"))
    return steps.withColumns(
        {
            "step_name": F.regexp_replace(name, r"\bPhase Asymmetry (not recovery|recovery)\b", "Phase Asymmetry  $1"),
            "settings": F.when(lower.isin(*P.PHASE_STEPS), to_sec).when(minutes, to_min).otherwise(settings),
            "voltages_pn": F.slice(F.transform(F.coalesce("voltages_pn", _none()), round_voltage), 1, 4),
            "voltage_pp": F.slice(F.transform(clean(pp_list), round_voltage), 1, 4),
            "leds": clean("leds"),
            "relay_status": blank_to_null(F.col("relay_status")),
            "on_delay": blank_to_null(F.col("on_delay")),
            "off_delay": blank_to_null(F.regexp_replace(off, r"^(\d{2,}[-–]\d+)\s*(SEC|sec)$", "OFF in $1 sec")),
            "section_break": F.coalesce("section_break", F.lit(False)) & ~lower.rlike("|".join(P.RECOVERY_STEPS)),
        }
    )


def count_steps(steps: DataFrame, keys: Sequence[str] = ("variant",)) -> DataFrame:
    """Real steps, without couple, supply-off and run-time-DIP markers."""
    marker = F.coalesce(F.col("step_name").rlike(f"(?i){P.MARKER_STEP}"), F.lit(False))
    return steps.groupBy(*keys).agg(F.count_if(~marker).alias("n_steps"))


def best_attempt(
    attempts: DataFrame, lo: int = P.MIN_STEPS, hi: int = P.MAX_STEPS, target: int = P.EXPECTED_STEPS, keys: Sequence[str] = ("variant",)
) -> DataFrame:
    """The earliest attempt with a step count in range; without one the closest to ``target``, the earlier on a tie."""
    in_range = F.col("n_steps").between(lo, hi)
    rank = F.struct(~in_range, F.when(in_range, F.lit(0)).otherwise(F.abs(F.col("n_steps") - target)), "attempt")
    return attempts.groupBy(*keys).agg(F.min_by(F.struct("attempt", "n_steps"), rank).alias("b")).select(*keys, "b.*")


def attempt_completeness(steps: DataFrame, context: DataFrame, keys: Sequence[str] = ("variant", "attempt"), on: Sequence[str] = ("variant",)) -> DataFrame:
    """Whether each attempt at a cut-off procedure has all it needs. ``context(variant, has_repeat, has_asymmetry)``."""
    name = F.lower("step_name")
    has = lambda t: F.bool_or(F.contains(name, F.lit(t)))
    seen = steps.groupBy(*keys).agg(
        (has("phase reverse") & has("couple all") & has("higher cut off")).alias("_required"),
        F.count_if(F.contains(name, F.lit("lower cut off healthy"))).alias("_healthy"),
        has("repeated tests").alias("_repeated"),
        F.count_if(~name.rlike(P.MARKER_STEP)).alias("n_steps"),
    )
    done = F.col("_required") & (~F.col("has_repeat") | (F.col("_healthy") >= 2)) & (~F.col("has_asymmetry") | F.col("_repeated"))
    return seen.join(context, list(on)).select(*keys, done.alias("complete"), "n_steps")


def best_attempt_complete(attempts: DataFrame, keys: Sequence[str] = ("variant",)) -> DataFrame:
    """The earliest complete attempt; without one the one with most steps, the earlier on a tie."""
    done = F.col("complete")
    rank = F.struct(~done, F.when(done, F.lit(0)).otherwise(-F.col("n_steps")), "attempt")
    return attempts.groupBy(*keys).agg(F.min_by(F.struct("attempt", "n_steps", "complete"), rank).alias("b")).select(*keys, "b.*")
