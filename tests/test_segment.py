"""Sequential operators against plain Python on small documents."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pageledger.functions import patterns as P
from pageledger.operators import segment as S

I = re.IGNORECASE
PROSE = ["plain words here", "more words of prose " * 6, "", "   ", "refer the table below", "as per table", "TABLE 1 (x", "TABLE", "2 (y", "SM7 note", "end"]
HEADS = ["PROCESS: Functional Testing SM11", "SM12 Visual Testing", "DMS5 unit", "For MG12AB product", "MG12AB Functional test", "SM13_A Functional Testing"]


def documents(seed, n=14):
    rnd = random.Random(seed)
    docs = {}
    for d in range(n):
        docs[d] = [
            "\n".join(rnd.choice(HEADS if rnd.random() < 0.25 else PROSE) for _ in range(rnd.randint(0, 9))) + ("\n" if rnd.random() < 0.3 else "") for _ in range(rnd.randint(1, 9))
        ]
    return docs


def dangling(text):
    recent = text[-200:].upper()
    return bool(re.search(P.DANGLING_REFERENCE, recent)) and not re.search(P.TABLE_STRUCTURE, text.upper())


def sequential(pages):
    """Blocks as [header, text, pages] by walking the lines once."""
    blocks, cur = [], ["", "", []]
    for number, page in enumerate(pages, 1):
        if number not in cur[2]:
            cur[2].append(number)
        for line in page.splitlines():
            line = line.strip()
            head = next((m for p in P.SECTION_PATTERNS if (m := re.search(p, line, I))), None) if line else None
            if head:
                force = any(re.search(p, line, I) for p in P.FORCE_SPLIT_PATTERNS)
                if not cur[1].strip() or force or (len(cur[1].strip()) > P.MIN_BLOCK_SIZE and not dangling(cur[1])):
                    if cur[1].strip():
                        blocks.append(cur)
                    cur = [head.group(0), line + "\n", [number]]
                    continue
            cur[1] += line + "\n"
    return blocks + ([cur] if cur[1].strip() else [])


def frame(spark, docs):
    return spark.createDataFrame([(d, n, t) for d, pages in docs.items() for n, t in enumerate(pages, 1)], "doc_id int, page_num int, text string")


def has_spec(text):
    return bool(re.search(P.TABLE_SPEC, text, I | re.S))


def test_blocks_pages_and_merging(spark):
    docs = documents(3)
    pages = frame(spark, docs)
    blocks, lines = S.segment_blocks(pages)
    want = {d: sequential(p) for d, p in docs.items()}
    got = {(r.doc_id, r.block_idx): (r.header, r.n_chars) for r in blocks.collect()}
    assert got == {(d, i): (b[0], len(b[1])) for d, bs in want.items() for i, b in enumerate(bs, 1)}
    owned = {tuple(r) for r in S.block_pages(pages, lines).collect()}
    assert owned == {(d, i, n) for d, bs in want.items() for i, b in enumerate(bs, 1) for n in b[2]}
    merge = {(r.doc_id, r.block_idx): r.merged_idx for r in S.merge_short_blocks(blocks, S.table_spec_blocks(lines)).collect()}
    expected = {}
    for d, bs in want.items():
        i = no = 0
        while i < len(bs):
            no += 1
            pair = len(bs[i][1]) < P.MIN_MERGE_SIZE and not has_spec(bs[i][1]) and i + 1 < len(bs)
            for j in range(i, i + 1 + pair):
                expected[(d, j + 1)] = no
            i += 1 + pair
    assert merge == expected


@pytest.mark.parametrize("seed", [1, 2])
def test_density_split(spark, seed):
    rnd = random.Random(seed)
    codes = ["AB12", "CD34", "EF56"]
    docs = {d: [" ".join(rnd.sample(codes, rnd.randint(0, 3))) or "none" for _ in range(rnd.randint(1, 12))] for d in range(12)}
    want = set()
    for d, pages in docs.items():
        group, size, seen = 1, 0, set()
        for n, t in enumerate(pages, 1):
            v = {c for c in codes if c in t.split()}
            if size >= 2 and len(v) >= 2 and v != seen:
                group, size, seen = group + 1, 1, v
            else:
                size, seen = size + 1, seen | v
            want.add((d, n, group))
    assert {tuple(r) for r in S.density_split(frame(spark, docs)).select("doc_id", "page_num", "group_no").collect()} == want


def test_repeated_names_get_suffixes(spark):
    df = spark.createDataFrame([(1, i, m) for i, m in enumerate(["A", "B", "A", "A"], 1)], "doc_id int, block_idx int, machine string")
    assert [r.machine for r in S.dedupe_names(df).orderBy("block_idx").collect()] == ["A", "B", "A_2", "A_3"]


def test_heading_always_splits_when_forced(spark):
    pages = frame(spark, {1: ["intro\nPROCESS: one\nx\nPROCESS: two"]})
    assert [r.header for r in S.segment_blocks(pages)[0].orderBy("block_idx").collect()] == ["", "PROCESS: one", "PROCESS: two"]
    assert S.segment_blocks(pages)[1].filter(F.col("block_idx") == 1).count() == 1
