"""Domain-shaped inputs derived from the test tables, as one text for Spark and for the checking SQL.

``ARR(`` and ``EMPTY_ARR`` stand for the two dialects' array constructors. A fixture with an ordinal names the rows it is
taken from, its key and its total order, which begins with a number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pageledger.operators.ordered import with_ordinal


@dataclass(frozen=True)
class Fixture:
    select: str
    source: str
    key: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    ordinal: str = ""


_LINE = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, CAST(l_quantity AS INT) AS q FROM lineitem"
_BY_PART = dict(
    source=_LINE,
    key=("l_partkey",),
    order=("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"),
)
_BY_ORDER = dict(
    source=_LINE,
    key=("l_orderkey",),
    order=("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"),
)
_PV = "concat('PV', lpad(CAST(l_partkey AS STRING), 6, '0'))"
_EXT = "concat('ext_', lpad(CAST(event_id AS STRING), 8, '0')"

_TABLE_IDX = "CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'PROMO' THEN 3 WHEN 'SMALL' THEN 4 ELSE 5 END"

FIXTURES: dict[str, Fixture] = {
    "fx_specs": Fixture(
        """p_brand AS machine, concat('PV', lpad(CAST(p_partkey AS STRING), 6, '0')) AS variant,
 CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'L-L' WHEN 2 THEN 'P-N' ELSE 'P-P' END AS voltage_unit,
 CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(200 + 10 * (p_partkey % 8) AS STRING) END AS ref_voltage,
 CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 6 = 1 THEN 'low' ELSE concat(CAST(p_size AS STRING), '%') END AS uv_threshold_pct,
 CASE WHEN p_partkey % 7 < 4 THEN NULL ELSE concat(CAST(p_size AS STRING), '% (sym)') END AS ov_threshold_pct,
 CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 11 = 5 THEN 'see table' ELSE concat(CAST(150 + p_size AS STRING), ' to ', CAST(170 + p_size + p_partkey % 3 AS STRING), ' VAC') END AS uv_range,
 CASE WHEN p_partkey % 4 IN (0, 1) THEN NULL ELSE concat(CAST(200 + p_size - p_partkey % 40 AS STRING), '-', CAST(260 + p_size AS STRING), ' VAC') END AS ov_range,
 CASE WHEN p_partkey % 10 = 3 THEN 'none' WHEN p_partkey % 10 = 4 THEN concat(CAST(p_size AS STRING), ' ± 5') ELSE NULL END AS asymmetry,
 CASE WHEN p_partkey % 9 = 0 THEN concat(CAST(160 + p_size AS STRING), 'V to ', CAST(180 + p_size AS STRING), 'V') ELSE NULL END AS lv_cutoff,
 CASE WHEN p_partkey % 9 = 0 THEN concat(CAST(150 + 20 * (p_partkey % 7) + p_size AS STRING), ' V') ELSE NULL END AS hv_cutoff,
 CASE p_partkey % 6 WHEN 0 THEN '4 to 6 sec' WHEN 1 THEN '10.5s' WHEN 2 THEN '7' WHEN 3 THEN '-' WHEN 4 THEN NULL ELSE 'Instant ON' END AS on_delay,
 CASE p_partkey % 7 WHEN 0 THEN '62 sec' WHEN 1 THEN '5 to 7' WHEN 2 THEN '' WHEN 3 THEN '300 ms' ELSE NULL END AS off_delay,
 CASE WHEN p_partkey % 13 = 0 THEN ARR('1 : ON', '2: OFF') ELSE EMPTY_ARR END AS dip_switches,
 CASE p_partkey % 5 WHEN 0 THEN ARR('Power LED', 'green', 'UV', 'red blink') WHEN 1 THEN ARR('R LED', 'fault') WHEN 2 THEN ARR('lamp', 'blue') ELSE EMPTY_ARR END AS led_words""",
        "part",
    ),
    "fx_steps": Fixture(
        f"""{_PV} AS variant, step_idx,
 CASE step_idx % 14 WHEN 0 THEN 'DIP S/W Change' WHEN 1 THEN 'healthy condition' WHEN 2 THEN 'UV symmetrical Healthy condition' WHEN 3 THEN 'UV faulty condition with delay' WHEN 4 THEN 'UV hysteresis recovery (sym)' WHEN 5 THEN 'Supply OFF' WHEN 6 THEN CASE WHEN q % 5 = 0 THEN 'Supply OFF change voltages' ELSE 'OV symmetrical not recovery Ph-N 240' END WHEN 7 THEN 'Phase fail' WHEN 8 THEN 'Phase reverse' WHEN 9 THEN CASE WHEN q % 3 = 0 THEN 'Supply couple at 415 VAC' ELSE 'OV Healthy condition' END WHEN 10 THEN CASE WHEN q % 2 = 0 THEN '' ELSE 'Under Voltage section' END WHEN 11 THEN CASE WHEN q % 6 = 1 THEN 'run time DIP check' ELSE 'Asymmetry recovery' END WHEN 12 THEN 'Run time DIP switch change error' ELSE CASE WHEN q % 2 = 0 THEN 'DIP S/W setting' ELSE 'Phase reverse recovery' END END AS step_name,
 CASE WHEN q % 11 = 0 THEN EMPTY_ARR WHEN q % 2 = 0 THEN ARR('UV = 8 %', 'OV = 22 %', 'DELAY = 5 sec') WHEN q % 3 = 0 THEN ARR('OV = 6%', 'P2 = 0 MIN', 'P3 = 0 SEC', 'DELAY = 5SEC') ELSE ARR('UV = 22 %', 'OV = 22%', 'P1 = 7%') END AS settings,
 CASE WHEN q % 13 = 0 THEN EMPTY_ARR WHEN q % 13 = 1 THEN ARR(concat('RN : ', CAST(q AS STRING)), 'n/a') WHEN q % 5 = 0 THEN ARR(concat('RN : ', CAST(100 + q AS STRING)), concat('YN : ', CAST(100 + q AS STRING)), concat('BN : ', CAST(100 + q AS STRING))) ELSE ARR(concat('RN : ', CAST(100 + q AS STRING)), concat('YN : ', CAST(100 + q AS STRING)), concat('BN : ', CAST(100 + q % 3 AS STRING), '.25')) END AS voltages_pn,
 CASE WHEN q % 6 = 0 THEN ARR('RY : 415.7', 'YB : 415', 'BR : 207.85') ELSE EMPTY_ARR END AS voltage_pp,
 CASE WHEN q % 4 = 0 THEN ARR('PWR (GREEN LED): ON', 'UV: Fast Blinking (1s ON)', 'ASY (RED LED) : Blinking') WHEN q % 4 = 1 THEN ARR('PWR: ON', 'UV: OFF', 'OV: OFF', 'ASY: Blinking') ELSE EMPTY_ARR END AS leds,
 CASE WHEN q % 3 = 0 THEN NULL ELSE 'ON' END AS relay_status,
 CASE WHEN q % 4 = 0 THEN '' WHEN q % 4 = 1 THEN '4 to 6 sec' WHEN q % 4 = 2 THEN '62 sec' ELSE NULL END AS on_delay,
 CASE WHEN q % 5 = 0 THEN NULL WHEN q % 5 = 1 THEN '62 sec' WHEN q % 5 = 2 THEN '14-16 SEC' WHEN q % 5 = 3 THEN '12' ELSE 'Instant OFF' END AS off_delay,
 (q % 7 = 0) AS section_break""",
        **_BY_PART, ordinal="step_idx",
    ),
    "fx_steps_b": Fixture(
        f"""{_PV} AS variant, step_idx,
 CASE step_idx % 16 WHEN 1 THEN 'healthy condition' WHEN 2 THEN 'Phase fail' WHEN 3 THEN 'Phase fail recovery' WHEN 4 THEN 'Phase reverse' WHEN 5 THEN 'Phase reverse recovery' WHEN 6 THEN 'Asymmetry healthy' WHEN 7 THEN 'Asymmetry faulty' WHEN 8 THEN 'Asymmetry not recovery' WHEN 9 THEN CASE WHEN l_partkey % 4 = 0 THEN 'Couple all Voltages' ELSE 'Asymmetry recovery' END WHEN 10 THEN 'Lower Cut OFF healthy' WHEN 11 THEN 'Lower Cut OFF' WHEN 12 THEN 'Lower Cut OFF not recovery' WHEN 13 THEN 'Lower Cut OFF recovery' WHEN 14 THEN 'Higher Cut OFF healthy (repeat block)' WHEN 15 THEN 'Higher Cut OFF' ELSE CASE WHEN l_partkey % 5 = 0 THEN 'Repeated Tests -' ELSE 'Phase recovery' END END AS step_name,
 ARR('P1 = 5%') AS settings,
 CASE WHEN q % 9 = 0 THEN EMPTY_ARR ELSE ARR(concat('RN : ', CAST(200 + q AS STRING)), concat('YN : ', CAST(200 + q AS STRING)), concat('BN : ', CAST(190 + q AS STRING))) END AS voltages_pn,
 CASE WHEN q % 2 = 0 THEN EMPTY_ARR ELSE ARR('RY : 415', 'YB : 410', 'BR : 410') END AS voltage_pp,
 CASE WHEN q % 3 = 0 THEN ARR('R(RED LED) : ON') WHEN q % 3 = 1 THEN ARR('R LED blinking fast') ELSE EMPTY_ARR END AS leds,
 CASE WHEN q % 3 = 0 THEN NULL ELSE 'ON' END AS relay_status,
 CASE WHEN q % 5 = 0 THEN NULL WHEN q % 5 = 1 THEN '< = 300 msec' WHEN q % 5 = 2 THEN '62 sec' WHEN q % 5 = 3 THEN '4 to 6 sec after power' ELSE '-' END AS on_delay,
 CASE WHEN q % 4 = 0 THEN NULL WHEN q % 4 = 1 THEN '-' WHEN q % 4 = 2 THEN '62sec' ELSE 'Instant OFF' END AS off_delay,
 (q % 7 = 0) AS section_break""",
        **_BY_PART, ordinal="step_idx",
    ),
    # pages of one variant's procedure, with the sentences the context parsers look for
    "fx_proc_pages": Fixture(
        f"""{_PV} AS variant, page_num,
 concat('Sheet ', CAST(q AS STRING), chr(10),
 CASE q % 12 WHEN 0 THEN concat('Set voltage ', CAST(100 + 20 * (l_partkey % 8) AS STRING), ' V Ph-N') WHEN 1 THEN concat('Low voltage cut off', chr(10), CAST(300 + q AS STRING), ' V to ', CAST(320 + q AS STRING), ' V ', CAST(4 + q % 3 AS STRING), ' V to 8 V') WHEN 2 THEN concat('Low voltage cut off ', CAST(290 + q AS STRING), ' V to ', CAST(280 + q AS STRING), ' V') WHEN 3 THEN concat('High voltage cut off ', CAST(460 + q AS STRING), ' V to ', CAST(480 + q AS STRING), ' V') WHEN 4 THEN CASE WHEN l_partkey % 3 = 0 THEN 'no asymmetry' ELSE concat('Fix Phase Asymmetry trip ', CAST(5 + q % 10 AS STRING), ' % and', chr(10), 'to ', CAST(20 + q % 7 AS STRING), ' % reset 3 % up to ', CAST(6 + q % 3 AS STRING), ' %') END WHEN 5 THEN CASE WHEN l_partkey % 2 = 0 THEN 'Now repeat procedure for all' ELSE 'done' END WHEN 6 THEN concat('symmetrically reduce all phases to ', CAST(400 + q AS STRING), ' V, couple') WHEN 7 THEN concat('C] Goal: run at ', CAST(120 + 120 * (l_partkey % 2) AS STRING), 'V Ph-N') WHEN 8 THEN concat('symmetric OV trip in the range of ', CAST(250 + q AS STRING), ' V to ', CAST(260 + q AS STRING), '.5 V', chr(10), 'hysteresis in the range of 4 V to ', CAST(5 + q % 4 AS STRING), ' V') WHEN 9 THEN concat('reset hysteresis voltage should be in the range of ', CAST(430 + q AS STRING), ' V to ', CAST(460 + q AS STRING), ' V') WHEN 10 THEN concat('Run time DIP 1=0, 2=1, 3=0, 4=1, 5=', CAST(l_partkey % 2 AS STRING), chr(10), '1 2 3 0 1 ', CAST(l_partkey % 2 AS STRING), chr(10), '4 1', chr(10), '5 0') ELSE concat('B] Goal: Over Voltage OV pot - ', CAST(4 + q % 5 AS STRING), ' % Delay pot - ', CAST(5 + q % 3 AS STRING), ' sec') END,
 chr(10), CASE WHEN q % 10 = 1 AND l_partkey % 3 = 1 THEN concat('PROCEDURE FOR CAT ID: ', {_PV}, ' R LED') ELSE '' END) AS text""",
        **_BY_PART, ordinal="page_num",
    ),
    "fx_pages": Fixture(
        f"""l_orderkey AS doc_id, page_num, concat('WORK INSTRUCTION SHEET ', CAST(l_orderkey AS STRING), chr(10),
 {_PV}, '  UV RANGE  ', CAST(150 + q AS STRING), ' to ', CAST(170 + q AS STRING), ' VAC  ', CASE WHEN q % 3 = 0 THEN 'NA' ELSE '10.5s' END, chr(10),
 CASE q % 4 WHEN 0 THEN concat('TABLE 1 (PRODUCT SETTINGS) REF. VOLTAGE ', CAST(200 + q AS STRING), ' VAC') WHEN 1 THEN 'TEST PROCEDURE' WHEN 2 THEN concat(CAST(q AS STRING), '. Set supply ON') ELSE '' END) AS text, (q % 10 <> 9) AS has_image""",
        **_BY_ORDER, ordinal="page_num",
    ),
    # pages with headings, scope lines, procedure markers and long prose
    "fx_manual": Fixture(
        f"""l_orderkey AS doc_id, page_num, concat('MAIN ASSEMBLY MANUAL ', CAST(l_orderkey AS STRING), chr(10),
 CASE WHEN l_orderkey % 3 = 0 AND page_num = 1 THEN concat('SCOPE: SM', CAST(10 + l_orderkey % 7 AS STRING), '_A / MAG03D', CAST(100 + l_orderkey % 40 AS STRING), ' ', CASE WHEN l_orderkey % 2 = 0 THEN concat('mag03d', CAST(100 + l_orderkey % 41 AS STRING)) ELSE '' END, '. end') ELSE '' END, chr(10),
 CASE q % 9 WHEN 0 THEN concat('PROCESS: Functional Testing SM', CAST(10 + l_orderkey % 7 AS STRING)) WHEN 1 THEN concat('PROCEDURE FOR CAT ID: ', {_PV}, ' R LED') WHEN 2 THEN concat('FUNCTIONAL TEST PROCEDURE FOR ', {_PV}) WHEN 3 THEN 'TABLE 1 (PRODUCT SETTINGS) REF. VOLTAGE 240 VAC' WHEN 4 THEN 'PROCESS: CLEANING & PACKING' WHEN 5 THEN concat('SM', CAST(20 + q AS STRING), ' Visual Testing') WHEN 6 THEN concat('DMS', CAST(q % 3 AS STRING), ' unit  refer table below') WHEN 7 THEN '1. Set supply ON' ELSE 'notes' END, chr(10),
 {_PV}, ' healthy condition ', CASE WHEN q % 2 = 0 THEN concat('PV', lpad(CAST(l_partkey + 1 AS STRING), 6, '0'), ' ', {_PV}, ' ') ELSE '' END, 'UV LED ON', chr(10),
 CASE WHEN q % 4 = 0 THEN concat('MAG03D', CAST(100 + l_orderkey % 40 AS STRING), '  UV RANGE  150 to 170 VAC  260-280 VAC  10.5s') ELSE '' END, chr(10),
 repeat(concat('sentence ', CAST(q AS STRING), ' of the text. '), CAST(1 + q % 30 AS INT)), chr(10),
 CASE WHEN q % 5 = 0 THEN 'as per table 2' ELSE 'end of page' END) AS text, (q % 10 <> 9) AS has_image""",
        **_BY_ORDER, ordinal="page_num",
    ),
    # up to three codes a page, the same ones for some pages, then others
    "fx_code_pages": Fixture(
        """l_partkey AS doc_id, page_num, concat('codes ', CASE WHEN q % 2 = 0 THEN 'AB12 ' ELSE '' END, CASE WHEN q % 3 = 0 THEN 'CD34 ' ELSE '' END, CASE WHEN q % 5 < 2 THEN concat('EF', CASE WHEN page_num % 12 < 6 THEN '5' ELSE '6' END, '6 ') ELSE '' END, 'end') AS text""",
        **_BY_PART, ordinal="page_num",
    ),
    # only pages with a spec marker: 9, 15 or up to 30 of them have an image
    "fx_marker_pages": Fixture(
        """l_partkey AS doc_id, page_num, concat('ACCEPTABLE LIMITS of part ', CAST(l_partkey AS STRING)) AS text, (page_num <= CASE l_partkey % 3 WHEN 0 THEN 9 WHEN 1 THEN 15 ELSE 30 END) AS has_image""",
        **_BY_PART, ordinal="page_num",
    ),
    # variants of the steps and others that have none
    "fx_variants": Fixture(
        "machine, variant",
        """SELECT p_brand AS machine, concat('PV', lpad(CAST(p_partkey AS STRING), 6, '0')) AS variant FROM part
UNION ALL SELECT concat('Supplier#', CAST(s_nationkey AS STRING)) AS machine, concat('SV', lpad(CAST(s_suppkey AS STRING), 6, '0')) AS variant FROM supplier""",
    ),
    # the corpus with a code and a heading on every page, so that detectors have something to find
    "fx_doc_pages": Fixture("source AS doc_id, doc_id AS page_num, text || chr(10) || 'For MG' || CAST(100 + doc_id % 9 AS STRING) || 'A product' AS text", "documents"),
    "fx_conv_pages": Fixture("conv_id AS doc_id, turn + 1 AS page_num, text || ' unit MG' || CAST(100 + turn % 5 AS STRING) || 'A' AS text", "conversations"),
    "fx_grid_cells": Fixture(
        """p_brand AS grid_id, CAST(rn AS INT) AS row_idx, p_type AS param, CAST(1 + s AS INT) AS col_idx,
 CASE WHEN m % 5 = 0 THEN '' WHEN m % 5 = 1 THEN 'NA' ELSE concat(CAST(m AS STRING), ' VAC') END AS value""",
        "SELECT p_brand, p_type, p_size % 4 AS s, max(p_size) AS m, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_type) AS rn FROM part GROUP BY p_brand, p_type, p_size % 4",
    ),
    # grids as cell arrays: a header row, labels with synonyms, blank, NA and filled cells
    "fx_grid": Fixture(
        """p_brand AS doc_id, CAST(1 + half AS INT) AS page_num, CAST(rn AS INT) AS row_idx,
 CASE WHEN rn = 0 THEN ARR('Parameter', concat('MG', substr(p_brand, 7), 'A1'), 'NOTE', concat('mg', substr(p_brand, 7), 'b2'), concat('MG', substr(p_brand, 7), 'A1'))
  ELSE ARR(CASE p_type WHEN 'PROMO' THEN ' uv range ' WHEN 'SMALL' THEN 'Under Voltage' WHEN 'LARGE' THEN 'on delay' ELSE p_type END,
   CASE WHEN a IS NULL THEN '' ELSE CASE WHEN a % 5 = 1 THEN 'NA' ELSE concat(CAST(a AS STRING), ' VAC') END END, 'x',
   CASE WHEN b IS NULL OR b % 3 = 0 THEN ' ' ELSE concat(CAST(b AS STRING), ' V') END, CASE WHEN c % 2 = 0 THEN '-' ELSE 'c' END) END AS cells""",
        """SELECT p_brand, p_type, p_size % 2 AS half, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_type) AS rn, max(CASE WHEN p_size % 3 = 0 THEN p_size END) AS a,
 max(CASE WHEN p_size % 3 = 1 THEN p_size END) AS b, max(p_size) AS c FROM part GROUP BY p_brand, p_type, p_size % 2
 UNION ALL SELECT DISTINCT p_brand, 'HEADER', p_size % 2, 0, 0, 0, 0 FROM part""",
    ),
    "fx_func_tables": Fixture(
        f"""p_brand AS family, {_TABLE_IDX} AS table_idx, concat(p_type, ' limits') AS title, CASE WHEN p_type = 'STANDARD' THEN 'aux' ELSE 'spec' END AS kind,
 CASE WHEN p_type = 'PROMO' AND substr(p_brand, 7, 1) = '1' THEN ARR('MG100', 'Column_2', 'MG102') WHEN p_type = 'SMALL' AND substr(p_brand, 7, 1) = '2' THEN ARR('110 VAC', '240 V', 'MG102') WHEN p_type = 'LARGE' AND p_brand = 'Brand#3' THEN ARR('MG100 5 %', 'MG103') WHEN p_type = 'MEDIUM' AND p_brand = 'Brand#5' THEN ARR('MX100 - A', 'MX101') WHEN p_type = 'LARGE' AND p_brand = 'Brand#6' THEN ARR('MG100 .x', 'MG103 (ACME)') WHEN p_type = 'MEDIUM' AND p_brand = 'Brand#7' THEN ARR('A100/121', 'A7/ /B') WHEN p_type = 'LARGE' THEN ARR('MG100A', 'MG100A') ELSE ARR('MG100A', 'MG101A/2A') END AS columns""",
        "SELECT DISTINCT p_brand, p_type FROM part",
    ),
    "fx_func_rows": Fixture(
        f"""p_brand AS family, {_TABLE_IDX} AS table_idx, row_idx,
 CASE WHEN p_partkey % 23 = 0 THEN '5 %' WHEN p_partkey % 29 = 0 THEN '' ELSE p_name END AS parameter, CAST(p_size AS STRING) AS setting,
 CASE WHEN p_partkey % 997 = 0 THEN ARR('1') WHEN p_type = 'PROMO' AND substr(p_brand, 7, 1) = '1' OR p_type = 'SMALL' AND substr(p_brand, 7, 1) = '2' THEN ARR('NA', CAST(p_size AS STRING), 'na') WHEN p_type = 'MEDIUM' AND p_brand = 'Brand#7' THEN ARR('7', CAST(p_size AS STRING), '8', '9') WHEN p_partkey % 4 = 0 AND p_type NOT IN ('LARGE', 'STANDARD') AND NOT (p_type = 'MEDIUM' AND p_brand = 'Brand#5') THEN ARR('NA', CAST(p_size AS STRING), 'NA') ELSE ARR(CAST(p_size AS STRING), 'NA') END AS vals""",
        "SELECT p_brand, p_type, p_partkey, p_name, p_size FROM part",
        key=("p_brand", "p_type"), order=("p_partkey",), ordinal="row_idx",
    ),
    # title lists of the families: known, known-empty and unknown
    "fx_families": Fixture(
        """p_brand AS family, CASE CAST(substr(p_brand, 7) AS INT) % 4 WHEN 0 THEN NULL WHEN 1 THEN EMPTY_ARR WHEN 2 THEN ARR('MG100A', 'MG101A', 'ZZ9') ELSE ARR('MX100', 'MX101') END AS title_submachines,
 (CAST(substr(p_brand, 7) AS INT) % 7 <> 3) AS external, CAST(1 + n % 50 AS INT) AS first_page, CAST(2 + n % 70 AS INT) AS last_page""",
        "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand",
    ),
    "fx_attempts": Fixture(
        """user_id AS variant, attempt, CAST(10 + event_id % 70 AS INT) AS n_steps, (event_id % 9 = 0) AS complete""",
        "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS attempt FROM events",
    ),
    "fx_cells_ref": Fixture(
        "sheet, row_no, col_no, value",
        """SELECT o_orderpriority AS sheet, o_orderkey AS row_no, 1 AS col_no, o_orderstatus AS value FROM orders
UNION ALL SELECT o_orderpriority, o_orderkey, 2, CAST(o_custkey AS STRING) FROM orders
UNION ALL SELECT o_orderpriority, o_orderkey, 3, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END FROM orders
UNION ALL SELECT concat('ref ', o_orderpriority), o_orderkey, 1, 'x' FROM orders""",
    ),
    "fx_cells_gen": Fixture(
        "sheet, row_no, col_no, value",
        """SELECT o_orderpriority AS sheet, o_orderkey AS row_no, 1 AS col_no, concat(' ', o_orderstatus, ' ') AS value FROM orders
UNION ALL SELECT o_orderpriority, o_orderkey, 2, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN concat(CAST(o_custkey AS STRING), '*') ELSE CAST(o_custkey AS STRING) END FROM orders
UNION ALL SELECT o_orderpriority, o_orderkey, 3, o_orderpriority FROM orders WHERE o_orderkey % 13 <> 0
UNION ALL SELECT concat('gen ', o_orderpriority), o_orderkey, 1, 'y' FROM orders""",
    ),
    "fx_runs": Fixture(
        f"""{_EXT}) AS extraction_id, user_id, event_type AS machine, CAST(event_id % 4 AS INT) AS num_machines,
 CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 4 = 0 THEN 'no_output' ELSE 'completed' END AS status,
 CASE WHEN event_type = 'error' THEN NULL ELSE ts END AS ts,
 CASE WHEN event_id % 4 = 0 THEN EMPTY_ARR ELSE ARR({_EXT}, '_', event_type, '.xlsx'), {_EXT}, '_', event_type, '_V', CAST(event_id % 3 AS STRING), '.xlsx'), {_EXT}, '_', event_type, '_All_CatID.xlsx')) END AS files""",
        "events",
    ),
    # one run for each user, some records cut short
    "fx_user_runs": Fixture(
        """concat('ext_', CAST(user_id AS STRING)) AS extraction_id, concat('user ', CAST(user_id AS STRING)) AS machine, CAST(n % 5 AS INT) AS num_machines, (user_id % 7 = 3) AS broken,
 CASE WHEN n % 3 = 0 THEN 'completed' ELSE 'no_output' END AS status, CASE WHEN n % 3 = 0 THEN ARR('a.xlsx', 'b.xlsx') ELSE EMPTY_ARR END AS files""",
        "SELECT user_id, count(*) AS n FROM events GROUP BY user_id",
    ),
    # stored model replies: fenced, with prose around, trailing data, or broken
    "fx_replies": Fixture(
        """user_id AS variant, event_id AS reply_id, CAST(event_id % 3 AS INT) AS chunk_idx,
 CASE event_id % 6 WHEN 0 THEN concat('```json', chr(10), body, chr(10), '```') WHEN 1 THEN concat('Here it is: ', body, ' Regards') WHEN 2 THEN concat(body, ' {"x": 1}') WHEN 3 THEN concat('[', body, ']') WHEN 4 THEN body ELSE concat('{"broken": ', body) END AS body""",
        """SELECT user_id, event_id, concat('{"M G', CAST(event_id % 4 AS STRING), '": {"uv_range": ', CASE WHEN event_id % 5 = 0 THEN 'null' ELSE concat('"', CAST(event_id % 90 AS STRING), ' to 200"') END, ', "ref_voltage": "', CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 7 = 1 THEN 'null' ELSE CAST(event_id % 11 AS STRING) END, '"}, "mg9": {"notes": "', event_type, '"}}') AS body FROM events""",
    ),
    "fx_step_replies": Fixture(
        """event_id AS reply_id,
 concat('{', CASE event_id % 5 WHEN 0 THEN '"test_steps": [], "steps"' WHEN 1 THEN '"test_steps"' WHEN 2 THEN '"procedure"' WHEN 3 THEN '"steps"' ELSE '"other"' END, ': [{"step_name": " ', event_type, ' ", "settings": ["P1 = ', CAST(event_id % 30 AS STRING), ' %"], "voltages_pn": ["RN : ', CAST(event_id % 300 AS STRING), '.', CAST(event_id % 10 AS STRING), '"], "off_delay": "', CAST(event_id % 20 AS STRING), '-16 SEC", "section_break": ', CASE event_id % 6 WHEN 0 THEN '"yes"' WHEN 1 THEN 'false' WHEN 2 THEN '1' WHEN 3 THEN '0' WHEN 4 THEN 'true' ELSE '""' END, '}, {"step_name": ""}, {"step_name": "Supply OFF", "leds": ["PWR: ON"]}',
 CASE WHEN event_id % 3 = 0 THEN ', "plain", {"step_name": 5}, {"step_name": "last"}' ELSE '' END,
 CASE WHEN event_id % 4 = 1 THEN ', {"step_name": 5, "note": {"step_name": "x"}}, {"step_name": "c", "x": {"section_break": "yes"}, "section_break": false, "voltage_pp": "[RY : 415.7", "settings": ["a", 0, null, 7, false, ""], "leds": "none", "off_delay": 0}, [{"step_name": "y"}]' ELSE '' END, ']}') AS body""",
        "events",
    ),
    "fx_table_replies": Fixture(
        """concat('FAM_', CAST(event_id AS STRING)) AS family,
 CASE WHEN event_id % 10 = 9 THEN '{"tables": [' WHEN event_id % 13 = 5 THEN '[{"tables": []}]' ELSE concat('```json', chr(10), '{', CASE WHEN event_id % 3 = 0 THEN concat('"family_label": "F', CAST(event_id AS STRING), '", "title_submachines": ', CASE event_id % 4 WHEN 0 THEN 'null' WHEN 1 THEN '[]' ELSE '["AB1", "AB2"]' END, ', "page_range": [1, 2], ') ELSE '' END,
 '"tables": [{"kind": "spec", "title": " ', event_type, ' ", "submachine_columns": ["AB1", "', CASE WHEN event_id % 5 = 0 THEN 'Column 2' ELSE 'AB2' END, '"], "rows": [{"parameter": "UV trip", "setting": "8%", "values": ["', CAST(user_id AS STRING), '", "NA"]}',
 CASE WHEN event_id % 7 = 0 THEN ', {"parameter": "x", "setting": "", "values": ["1"]}' ELSE '' END, CASE WHEN event_id % 11 = 3 THEN ', "stray"' ELSE '' END, ']}, ', CASE WHEN event_id % 11 = 7 THEN '"junk", ' ELSE '' END, '{"kind": "aux", "title": "jig", "rows": [{"parameter": "p", "setting": "s", "values": ["1", "2"]}]}]}', chr(10), '```') END AS body""",
        "events",
    ),
    # raw page classification rows: not every page has one, some labels are missing
    "fx_page_meta": Fixture(
        """l_orderkey AS doc_id, page_num, CASE q % 6 WHEN 0 THEN NULL WHEN 1 THEN 'family_start' WHEN 2 THEN 'mixed' WHEN 3 THEN 'table' ELSE 'procedure' END AS content_type,
 CASE WHEN q % 4 = 0 THEN NULL ELSE concat('FAM', CAST(q AS STRING)) END AS family_label""",
        **_BY_ORDER, ordinal="page_num",
    ),
}


def _dialect(text: str, spark: bool) -> str:
    if spark:
        return text.replace("EMPTY_ARR", "CAST(array() AS ARRAY<STRING>)").replace("ARR(", "array(")
    return text.replace("EMPTY_ARR", "CAST([] AS VARCHAR[])").replace("ARR(", "list_value(")


def _source(f: Fixture) -> str:
    return f.source if f.source.startswith("SELECT") else f"SELECT * FROM {f.source}"


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Spark side. Base tables are read straight from Parquet, so pruning and pushdown apply."""
    f = FIXTURES[name]
    text = _dialect(_source(f), True)
    for t in ("lineitem", "part", "orders", "events", "documents", "conversations", "supplier"):
        text = text.replace(f"FROM {t}", f"FROM parquet.`{sf_dir}/{t}.parquet`")
    df = spark.sql(text)
    if f.key:
        df = with_ordinal(df, f.key, f.order, f.ordinal)
    select = _dialect(f.select, True).replace("{", "{{").replace("}", "}}")
    return spark.sql(f"SELECT {select} FROM {{t}}", t=df)


def fixture_sql(name: str) -> str:
    """The checking side: the body of a common table expression."""
    f = FIXTURES[name]
    inner = _dialect(_source(f), False)
    if f.key:
        over = f"row_number() OVER (PARTITION BY {', '.join(f.key)} ORDER BY {', '.join(f.order)})"
        inner = f"SELECT *, CAST({over} AS INT) AS {f.ordinal} FROM ({inner}) b"
    return f"SELECT {_dialect(f.select, False)} FROM ({inner}) t"
