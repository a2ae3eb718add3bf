"""From specs and steps to positioned sheet cells.

The rows a step takes are a column expression; its position is a running sum over the steps of the variant.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pageledger.functions.text import filled, rx, strip
from pageledger.operators.ordered import UNKNOWN, following, running_max, running_sum, width_for, with_running

KEYS = ("variant",)

# First step row, LED rows and column numbers of the two layouts, and the texts of their headers.
FIRST_ROW = {"A": 10, "B": 5}
LED_ROWS = {"A": 4, "B": 1}
COLUMNS = {
    "A": {"step": 6, "settings": 7, "pn": 8, "pp": 9, "led": 10, "relay": 11, "on": 12, "off": 13},
    "B": {"step": 6, "pn": 7, "pp": 8, "led": 9, "relay": 10, "on": 11, "off": 12},
}
HEADER = {
    "A": [
        (2, "step", "Test cases/ parameters"), (2, "settings", "POT Setting"), (2, "pn", "Voltage Setting"), (2, "led", "LED STATUS"), (2, "relay", "relay status"),
        (2, "on", "On delay"), (2, "off", "off delay"), (3, "step", "DIP S/W setting"), (9, "settings", "Couple voltage setting"), (9, "pn", "PH-N"), (9, "pp", "PH -PH"),
    ],
    "B": [
        (2, "led", "LED STATUS"), (2, "relay", "relay status"), (2, "on", "On delay"), (2, "off", "off delay"), (4, "pn", "PH-N"), (4, "pp", "PH -PH"),
    ],
}
NO_DATA = "NO DATA EXTRACTED — CHECK PDF / VISION"
RUN_TIME_ERROR = "Run time DIP switch change error"
HEADER_SEQ = -1  # written before any step
PLACED_ROWS = 50_000  # placed steps of a task: some half a million cells, sorted in memory
CELL = "array<struct<row:int,col:int,value:string,seq:int>>"


def _strings(name: str) -> Column:
    return F.coalesce(name, F.array().cast("array<string>"))


def detect_layout(specs: DataFrame, steps: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Ordered rules: every step with LEDs shows one red one → B; a step with three LEDs → A; cut-offs only → B; reference voltage
    of 230 or more without switches, thresholds and ranges → B; else A."""
    n = F.size(_strings("leds"))
    one = F.get("leds", 0)
    rolled = steps.groupBy(*keys).agg(
        F.count_if(n > 0).alias("_led"), F.count_if((n == 1) & rx(one, r"R\s*\(.*RED")).alias("_red"), F.count_if(n >= 3).alias("_many"),
        F.count_if((n == 1) & F.contains(one, F.lit("R ("))).alias("_r"), F.count("*").alias("_n"),
    )
    led, red, many, r = (F.coalesce(c, F.lit(0)) for c in ("_led", "_red", "_many", "_r"))
    f = {c: filled(F.col(c)) for c in ("uv_threshold_pct", "ov_threshold_pct", "uv_range", "ov_range", "lv_cutoff", "hv_cutoff", "ref_voltage")}
    thresholds, ranges, cutoffs = f["uv_threshold_pct"] | f["ov_threshold_pct"], f["uv_range"] | f["ov_range"], f["lv_cutoff"] | f["hv_cutoff"]
    dips = F.size(_strings("dip_switches")) > 0
    volts = F.coalesce(F.nullif(strip(F.replace("ref_voltage", F.lit("V"), F.lit(""))), F.lit("")).try_cast("double"), F.lit(0.0))
    empty = ~(thresholds | ranges | cutoffs | dips | f["ref_voltage"])
    layout = (
        F.when((led > 0) & (red == led), "B").when(many > 0, "A").when(~thresholds & ~ranges & cutoffs, "B")
        .when(empty & (led > 0) & (r == led), "B").when((volts >= 230) & ~dips & ~thresholds & ~ranges, "B").otherwise("A")
    )
    return specs.join(rolled, list(keys), "left").select(*keys, layout.alias("layout"))


def dip_states(settings: Column) -> Column:
    """"DIP S/W 1-5 : 00101" or "2 : ON" items as "1 : OFF", "2: ON", …; a bit string ends the list."""
    up = F.transform(settings, lambda s: strip(F.upper(s)))
    bit_rx, item_rx = r"DIP\s*S/?W.*?:\s*([01]+)", r"^(\d+)\s*:\s*(ON|OFF)\b"
    with_bits = F.filter(F.transform(up, lambda s, i: F.struct(i.alias("i"), F.regexp_extract(s, bit_rx, 1).alias("b"))), lambda x: x["b"] != "")
    stop = F.get(with_bits, 0)
    head = F.when(stop.isNull(), up).otherwise(F.slice(up, F.lit(1), stop["i"]))
    items = F.transform(
        F.filter(head, lambda s: s.rlike(item_rx)),
        lambda s, i: F.concat(
            F.regexp_extract(s, item_rx, 1), F.when((i == 0) | (F.regexp_extract(s, item_rx, 1).cast("int") == 1), " : ").otherwise(": "), F.regexp_extract(s, item_rx, 2)
        ),
    )
    bits = F.transform(
        F.filter(F.split(F.coalesce(stop["b"], F.lit("")), ""), lambda b: b != ""),
        lambda b, i: F.concat((i + 1).cast("string"), F.when(i == 0, " : ").otherwise(": "), F.when(b == "1", "ON").otherwise("OFF")),
    )
    return F.concat(items, bits)


def parse_dip(steps: DataFrame) -> DataFrame:
    return steps.withColumn("dips", dip_states(_strings("settings")))


def step_advance(steps: DataFrame, layouts: DataFrame, keys: Sequence[str] = KEYS, width: int | None = UNKNOWN) -> DataFrame:
    """Adds ``layout``, ``kind`` and ``advance``, the sheet rows the step takes. ``width`` is what ``width_for`` gave for the steps, if they were looked at before.

    Kinds: header_dip, dip, hidden, couple, decouple, couple_volts, label, step.
    """
    k = list(keys)
    name = F.coalesce("step_name", F.lit(""))
    low, trimmed = F.lower(name), F.lower(strip(name))
    has = lambda t: F.contains(trimmed, F.lit(t))
    pn, pp, led, settings = (F.size(_strings(c)) for c in ("voltages_pn", "voltage_pp", "leds", "settings"))
    in_a = F.col("layout") == "A"
    functional = (pn > 0) | (led > 0) | filled(F.col("relay_status"))
    is_dip = F.contains(name, F.lit("DIP S/W"))
    is_label = (name != "") & ~functional & F.col("section_break") & ~F.contains(name, F.lit("DIP"))
    ordinary = ~is_dip & ~is_label
    # the smallest number of a DIP step and of an ordinary one, as far as a step of that kind sees: rows that share a number are all first
    place = F.col("step_idx")
    firsts = {"_first_dip": running_max(F.when(is_dip, -place)), "_first_step": running_max(F.when(ordinary, -place))}
    s = with_running(steps, k, "step_idx", width=width, _next=following(trimmed), **firsts).join(layouts, k)
    first = lambda c: F.coalesce(-place == F.col(c), F.lit(False))
    kind = (
        F.when(is_dip & in_a & first("_first_dip"), "header_dip").when(is_dip, "dip").when(~is_label, "step").when(trimmed == "supply off", "hidden")
        .when(has("decouple"), "decouple").when(has("couple") & ~has("supply couple"), "couple").when(has("supply couple"), "couple_volts").otherwise("label")
    )
    states = F.size(dip_states(_strings("settings")))
    used = F.greatest(F.lit(3), F.when(in_a, settings).otherwise(0), F.when(in_a, LED_ROWS["A"]).otherwise(LED_ROWS["B"]), pn, pp)
    room = lambda total: F.greatest(F.lit(total) - used, F.lit(1))
    brk = F.col("section_break")
    blank_b = (
        F.when(brk | (ordinary & first("_first_step")), 3).when(low == "lower cut off", room(6))
        .when(F.contains(low, F.lit("lower cut off recovery")) & F.coalesce(F.startswith("_next", F.lit("repeated tests")), F.lit(False)), room(4)).otherwise(room(5))
    )
    ordinary_rows = F.when(name == RUN_TIME_ERROR, 1).otherwise(used + F.when(in_a, F.when(brk, 2).otherwise(1)).otherwise(blank_b))
    dip_rows = F.when(functional, F.greatest(states, pn, led, F.lit(3)) + 1).otherwise(F.greatest(states, F.lit(1)) + F.when(brk, 2).otherwise(1))
    advance = (
        F.when(kind == "step", ordinary_rows).when(kind == "dip", dip_rows).when(kind.isin("couple_volts", "label"), F.when(in_a, 4).otherwise(2)).otherwise(0)
    )
    return s.withColumns({"kind": kind, "advance": advance.cast("int")}).drop("_next", *firsts)


def layout_rows(advanced: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds ``start_row``: the layout's first row plus the rows of all earlier steps."""
    out = with_running(advanced, list(keys), "step_idx", _rows=running_sum(F.col("advance"), inclusive=False))
    first = F.when(F.col("layout") == "A", FIRST_ROW["A"]).otherwise(FIRST_ROW["B"])
    return out.withColumn("start_row", (first + F.col("_rows")).cast("int")).drop("_rows")


def _column(role: str) -> Column:
    return F.when(F.col("layout") == "A", COLUMNS["A"].get(role)).otherwise(F.lit(COLUMNS["B"].get(role)).cast("int"))


def _one(row: Column, role: str, value: Column, when: Column, seq: int = 0) -> Column:
    cell = F.struct(row.cast("int").alias("row"), _column(role).alias("col"), value.alias("value"), F.lit(seq).alias("seq"))
    return F.when(F.coalesce(when, F.lit(False)), F.array(cell)).otherwise(F.array().cast(CELL))


def _down(row: Column, role: str, values: Column, when: Column, seq: int = 0) -> Column:
    """A list written downwards from ``row``."""
    cells = F.transform(values, lambda v, i: F.struct((row + i).cast("int").alias("row"), _column(role).alias("col"), v.alias("value"), F.lit(seq).alias("seq")))
    return F.when(F.coalesce(when, F.lit(False)), cells).otherwise(F.array().cast(CELL))


def _step_cells() -> Column:
    row, kind, in_a = F.col("start_row"), F.col("kind"), F.col("layout") == "A"
    step, dip = kind == "step", kind == "dip"
    functional = (F.size(_strings("voltages_pn")) > 0) | (F.size(_strings("leds")) > 0) | filled(F.col("relay_status"))
    body = step | (dip & functional)
    states = dip_states(_strings("settings"))
    header = F.when(F.size(states) > 0, states).otherwise(_strings("dip_switches"))
    leds = F.when(in_a, F.slice(_strings("leds"), 1, LED_ROWS["A"])).otherwise(F.slice(_strings("leds"), 1, LED_ROWS["B"]))
    name = F.coalesce("step_name", F.lit(""))
    return F.concat(
        _one(row, "step", name, step | (kind == "label")),
        _one(row, "pn", name, kind == "couple_volts"),
        _one(row - 1, "settings", name, kind.isin("couple", "decouple") & in_a),
        _one(row - 1, "step", F.lit("Supply OFF"), dip & ~functional),
        _one(row, "step", F.lit("DIP S/W setting"), dip),
        _down(row, "settings", _strings("settings"), step & in_a),
        _down(row, "settings", F.slice(states, 1, 5), dip & in_a),
        _down(F.lit(3), "settings", F.slice(header, 1, 5), kind == "header_dip"),
        _down(row, "pn", F.slice(_strings("voltages_pn"), 1, 4), body),
        _down(row, "pp", F.slice(_strings("voltage_pp"), 1, 4), body),
        _down(row, "led", leds, body),
        _one(row, "relay", F.col("relay_status"), body & filled(F.col("relay_status"))),
        _one(row, "on", F.col("on_delay"), body & filled(F.col("on_delay"))),
        _one(row, "off", F.col("off_delay"), body & filled(F.col("off_delay"))),
    )


def header_cells(specs: DataFrame, layouts: DataFrame, steps: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Header texts and switches per variant, and the notice of a variant without data."""
    k = list(keys)
    present = steps.select(*k).distinct().withColumn("_has", F.lit(True))
    d = layouts.distinct().join(_by_key(specs, k), k).join(present, k, "left")
    first = F.when(F.col("layout") == "A", FIRST_ROW["A"]).otherwise(FIRST_ROW["B"])
    nothing = F.col("_bare") & F.col("_has").isNull()
    cells = F.concat(_header(), _one(first, "step", F.lit(NO_DATA), nothing))
    return d.select(*k, F.lit(0).alias("step_idx"), F.explode(cells).alias("c"))


def _header() -> Column:
    texts = [_one(F.lit(r), role, F.lit(text), F.col("layout") == name, HEADER_SEQ) for name, cells in HEADER.items() for r, role, text in cells]
    return F.concat(*texts, _down(F.lit(3), "settings", _strings("dip_switches"), F.col("layout") == "A", HEADER_SEQ))


def _by_key(specs: DataFrame, k: list[str]) -> DataFrame:
    """One row per key, though specs may share one: the longest list of switches, and whether a spec has no reference voltage.

    Joined as they are, m specs of a key would write each of its cells m times.
    """
    switches = _strings("dip_switches")
    return specs.groupBy(*k).agg(F.max_by(switches, F.struct(F.size(switches), switches)).alias("dip_switches"), F.bool_or(~filled(F.col("ref_voltage"))).alias("_bare"))


def sheet_cells(specs: DataFrame, steps: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, row_no, col_no, value) of every filled cell; where two writes meet the later one wins.

    The header is written by the steps with the variant's first number, or by an empty row where there are no steps. So all cells of a variant arise where its steps were placed:
    they are many times the steps and are not dealt out again.
    """
    k = list(keys)
    layouts = detect_layout(specs, steps, keys)
    rows = steps.withColumn("_empty", F.lit(False)).unionByName(specs.select(*k).distinct().join(steps.select(*k).distinct(), k, "left_anti").withColumn("_empty", F.lit(True)), allowMissingColumns=True)
    width = width_for(steps, k, "step_idx")
    if width is None:  # else long variants are dealt out in chunks
        placed_rows = steps.groupBy(*k).agg(F.count("*").alias("_n")).join(specs.groupBy(*k).agg(F.count("*").alias("_m")), k).agg(F.sum(F.col("_n") * F.col("_m"))).first()[0] or 0
        rows = rows.repartition(max(steps.sparkSession.sparkContext.defaultParallelism, -(-placed_rows // PLACED_ROWS)), *k)
    first = with_running(rows, k, "step_idx", width=width, _first=running_max(-F.col("step_idx"), peers=True))
    first = first.withColumn("_first", F.col("_first").eqNullSafe(-F.col("step_idx")))
    placed = layout_rows(step_advance(first, layouts, keys, width), keys).join(_by_key(specs, k), k)
    none = F.array().cast(CELL)
    notice = _one(F.when(F.col("layout") == "A", FIRST_ROW["A"]).otherwise(FIRST_ROW["B"]), "step", F.lit(NO_DATA), F.col("_empty") & F.col("_bare"), HEADER_SEQ)
    cells = F.concat(F.when(F.col("_first"), _header()).otherwise(none), notice, F.when(F.col("_empty"), none).otherwise(_step_cells()))
    written = placed.select(*k, "step_idx", F.explode(cells).alias("c"))
    at = F.struct(F.when(F.col("c.seq") == HEADER_SEQ, 0).otherwise(F.col("step_idx")).alias("step_idx"), "c.seq")
    told = written.select(*k, F.col("c.row").alias("row_no"), F.col("c.col").alias("col_no"), at.alias("_at"), "c.value")
    return told.groupBy(*k, "row_no", "col_no").agg(F.max_by("value", "_at").alias("value")).filter(filled(F.col("value")))
