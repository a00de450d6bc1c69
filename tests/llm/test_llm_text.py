"""Line dedup, quality rules, licence scans: brute force on awkward rows."""

from __future__ import annotations

import hashlib
import re
import textwrap
from collections import Counter, defaultdict
from importlib.resources import files

import pytest
from llm_frames import documents, edge_docs, edge_rows
from pyspark.sql import functions as F

from lodgecast.llm.license_scan import scan_licenses
from lodgecast.llm.license_texts import BSD_2, BSD_3, FILES, KNOWN, MIT
from lodgecast.llm.line_dedup import drop_shared_lines, line_report
from lodgecast.llm.quality_rules import MIN_GROUP, judge, keep_good, measure_rules, rules_report
from lodgecast.plans.storage import stored

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\f\r"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def lines_by_hand(docs, min_docs=2, min_chars=10):
    holders = defaultdict(set)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            holders[line.strip(SPACE).translate(LOW)].add(doc_id)
    out = []
    for doc_id, text in docs:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            key = line.strip(SPACE).translate(LOW)
            ids = holders[key]
            numbered = [i for i in ids if i is not None]
            shared = len(key) >= min_chars and len(ids) >= min_docs and numbered
            if not (shared and (doc_id is None or doc_id > min(numbered))):
                kept.append(line)
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((doc_id, len(lines), len(lines) - len(kept), digest))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    docs = edge_docs(spark)
    found = sorted((tuple(r) for r in line_report(docs).collect()), key=repr)
    assert found == lines_by_hand(documents(docs))
    assert any(r[2] for r in found)


def test_line_dedup_with_a_higher_threshold(spark):
    docs = edge_docs(spark)
    kept = drop_shared_lines(docs, min_docs=4)
    assert kept.columns[: len(docs.columns)] == docs.columns
    found = sorted(
        (r.doc_id, r._llm_lines, r._llm_dropped, hashlib.sha256(r.text.encode()).hexdigest())
        for r in kept.filter("doc_id is not null").collect()
    )
    by_hand = [r for r in lines_by_hand(documents(docs), min_docs=4) if r[0] is not None]
    assert found == sorted(by_hand)


def rules_by_hand(text):
    text = text or ""
    own = words(text)
    solid = [x for x in text.split("\n") if x.strip(SPACE)]
    windows = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    counts = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    return (
        len(own),
        sum(map(len, own)),
        sum(c in "#*$%&|<>" for c in text),
        len(solid) - len(set(solid)),
        len(repeated),
        len(own) < 50 or 100 * len(repeated) > 50 * len(own),
    )


def test_quality_measures(spark):
    docs = edge_docs(spark)
    found = sorted((tuple(r)[:-1] for r in rules_report(docs).collect()), key=repr)
    assert found == sorted(((i, *rules_by_hand(t)) for i, t in documents(docs)), key=repr)


def test_quality_verdicts(spark):
    docs = edge_docs(spark)
    verdicts = rules_report(docs).collect()
    assert not any(r.kept for r in verdicts if r.base_failed)
    good = keep_good(docs)
    assert good.columns == docs.columns
    assert good.count() == sum(r.kept for r in verdicts)


def test_fences_follow_the_group(spark):
    """Documents far from the bulk of their language go; a source of junk cannot save its own.

    The bulk is three quarters, so the junk may be a smaller share of the language.
    """
    plain = " ".join(f"w{i}" for i in range(60))
    rows = [(i, plain, "en", "clean") for i in range(5 * MIN_GROUP)]
    rows += [(10_000 + i, plain + " ####" * 20, "en", "junk") for i in range(MIN_GROUP + 5)]
    rows += [(20_000 + i, plain + " ####" * 20, "xx", "code") for i in range(MIN_GROUP + 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = judge(stored(measure_rules(docs))).filter("_llm_kept").groupBy("source").count()
    counts = {r["source"]: r["count"] for r in kept.collect()}
    assert counts == {"clean": 5 * MIN_GROUP, "code": MIN_GROUP + 5}


def test_licences(spark):
    copies = [
        "Copyright (c) 2020 Somebody\n\n" + MIT.upper().replace(",", " ,"),
        "MIT License\n\nCopyright 1999 by X\nAll rights reserved.\n" + MIT.replace("\n", "\r\n\n"),
        BSD_3.replace("COPYRIGHT HOLDER", "copyright owner").replace('"AS IS"', "“as is”"),
        MIT + " and more",
        "text before\nReleased under the MIT licence.\nLicensed under CC BY-NC 4.0\nlicensed under cc by-nc 4.0.",
    ]
    docs = edge_docs(spark, [*edge_rows(), *[(100 + i, t, None, None) for i, t in enumerate(copies)]])
    found = {r.doc_id: r for r in scan_licenses(docs).filter("doc_id >= 100").collect()}
    assert [found[100 + i].license_id for i in range(5)] == ["MIT", "MIT", "BSD-3-Clause", None, None]
    assert found[104].notice_ids == ["CC-BY-NC-4.0", "MIT"] and found[104].n_notice_lines == 3
    assert scan_licenses(docs).count() == docs.count()
    assert scan_licenses(docs).filter("doc_id < 100 and license_id is not null").count() == 0


def test_full_licence_texts_and_generated_notices(spark):
    """Published texts are known whole and without their appendix; notices come from templates."""
    texts = {n: files("lodgecast.llm").joinpath(f"licenses/{n}.txt").read_text("utf-8") for n in FILES}
    apache = texts["Apache-2.0"]
    filled = apache.replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2021 Somebody")
    copies = [*texts.items(), ("Apache-2.0", filled), ("Apache-2.0", apache.partition("   APPENDIX")[0])]
    lines = [
        ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
        ("BSD-3-Clause", "# SPDX-License-Identifier: BSD-3-Clause"),
        ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
        ("AGPL-3.0-or-later", "SPDX-License-Identifier: AGPL-3.0-or-later"),
        ("MPL-2.0", "This project is released under the Mozilla Public Licence, version 2.0"),
    ]
    rows = [(i, t, None, None) for i, (_, t) in enumerate(copies)]
    rows += [(100 + i, f"some text\n{t}\nmore", None, None) for i, (_, t) in enumerate(lines)]
    found = {r.doc_id: r for r in scan_licenses(edge_docs(spark, rows)).collect()}
    assert [found[i].license_id for i in range(len(copies))] == [n for n, _ in copies]
    assert [found[100 + i].notice_ids for i in range(len(lines))] == [[n] for n, _ in lines]


def wrapped(text, width):
    """Paragraphs of a text wrapped anew; lines of the copyright notice stay lines."""
    out, paragraph = [], []
    for line in [*text.split("\n"), ""]:
        notice = re.match(r"\s*copyright (\(c\)|©|[0-9]{4})", line, re.IGNORECASE)
        if notice or not line.strip():
            out += [*textwrap.wrap(" ".join(paragraph), width, break_long_words=False), line]
            paragraph = []
        else:
            paragraph.append(line)
    return "\n".join(out)


def test_line_breaks_do_not_change_a_licence(spark):
    """Every known whole text at every width from 40 to 120, also with a spelling of two words."""
    whole = [(n, t) for n, t in KNOWN if "\n" in t]
    whole += [("MIT", MIT.replace("sublicense", "sub license").replace("NONINFRINGEMENT", "NON-INFRINGEMENT"))]
    whole += [("BSD-2-Clause", BSD_2.replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR"))]
    whole += [("BSD-3-Clause", BSD_3.replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR"))]
    copies = [(n, wrapped(t, width)) for n, t in whole for width in range(40, 121)]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(copies)], "doc_id long, text string").repartition(16)
    found = {r.doc_id: r.license_id for r in scan_licenses(docs).select("doc_id", "license_id").collect()}
    assert [(i, found[i]) for i, (n, _) in enumerate(copies) if found[i] != n] == []


def test_copyright_lines_are_dropped(spark):
    heads = ["Copyright Holder 2020 X", "Copyright holders (c) 2019 Y", "Copyright (c) 2020 Z", "Copyright by W", "(c) 2020 V"]
    docs = edge_docs(spark, [(i, f"{h}\n\n{MIT}", None, None) for i, h in enumerate(heads)])
    assert [r.license_id for r in scan_licenses(docs).collect()] == ["MIT"] * len(heads)


@pytest.mark.parametrize("operator", [line_report, rules_report, scan_licenses, keep_good])
def test_empty_tables(spark, operator):
    assert operator(edge_docs(spark).filter(F.lit(False))).count() == 0
