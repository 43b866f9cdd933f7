"""The plans of queries: how large they are, what is evaluated how often, which rows are shuffled."""

import os

import pytest

from tallyspark.jobs import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["classified", "detect_recurring", "recurring_total", "needs_enrichment", "filter_transactions", "payment_gaps", "by_category", "export_rows"])
def test_classification_is_evaluated_once(spark, name):
    """No filter on classified columns is written out as what they are made of."""
    text = plan(registry.QUERIES[name](spark, SF))
    assert text.count("regexp_replace") <= 4 and text.count("regexp_extract_all") <= 2
    assert not [line for line in text.splitlines() if line.lstrip(" :+-").startswith("Filter") and "regexp" in line]
    assert len(text) < 60_000


def test_rows_of_files_that_share_no_day_are_not_shuffled(spark, tmp_path):
    """Rows that no other file can hold too stay where they are; the others meet by hash; results are those of comparing all."""
    import datetime as dt

    from pyspark.sql import functions as F

    from tallyspark.operators import merge

    rows = [(a, f, 10 * i, dt.date(2026, 1, 1) + dt.timedelta(days=day), "debit", 5 + i % 3, None, f"X {i % 4}") for a in range(4) for f, first in ((0, 0), (1, 20 if a % 2 else 40)) for i, day in enumerate(range(first, first + 30))]
    rows += [(9, 0, 1, None, "debit", 1, None, "no date"), (9, 1, 1, None, "debit", 1, None, "no date"), (9, 1, 2, None, "debit", 1, None, "other")]
    df = spark.createDataFrame(rows, "account_id long, file_idx int, seq long, date date, direction string, amount int, balance int, description string")
    df.write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    out = merge.remove_cross_file_duplicates(df)
    got, want = sorted(out.collect(), key=str), sorted(merge.first_files(df, ("account_id",)).collect(), key=str)
    assert got == want and len(got) < len(rows)
    lines = out._jdf.queryExecution().sparkPlan().toString().splitlines()
    second = next(i for i, line in enumerate(lines) if line.startswith("+-"))
    assert lines[0].startswith("Union") and not [line for line in lines[1:second] if "Aggregate" in line or "SortMerge" in line or "Window" in line or "BuildLeft" in line]
    whole = out._jdf.queryExecution().executedPlan().toString()
    one = whole[whole.index(":-") : whole.index("\n   +-")] if "\n   +-" in whole else ""
    assert "Exchange hashpartitioning" not in one and out.filter(F.col("account_id") == 0).count() == 60


@pytest.mark.parametrize("name", ["lines_classified", "lines_by_category", "lines_by_merchant", "lines_representatives", "lines_findings"])
def test_order_lines_are_summed_by_hash_and_descriptions_read_in_one_pass(spark, name):
    """No order line is sorted to be summed or named, and normalising is one replacement."""
    from tallyspark.sources import lineitem_ledger

    text = lineitem_ledger.ledger(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in text and "SortAggregate" not in text and "Sort [" not in text
    if name != "lines_findings":  # it writes the classified rows first
        text = plan(registry.QUERIES[name](spark, SF))
        assert text.count("regexp_replace") <= (3 if name == "lines_representatives" else 1)


def test_patterns_that_look_first_find_what_plain_ones_find(spark):
    """Kinds, dictionary words and normalised text are those of the plain patterns, on odd words and white space too."""
    import random
    import re

    from pyspark.sql import functions as F

    from tallyspark.functions import dims, text

    draw = random.Random(3)
    words = [k for _, _, keys in dims.MERCHANTS for k in keys] + ["QRIS", "QR PAY", "BI-FAST", "TOP UP", "VA 1", "THR", "X", "ADMIN FEE", "PLN-PRA", "936123456789012", "BAYAR QR"]
    said = ["".join(draw.choice(words)[: draw.choice((2, 5, 20))] + draw.choice((" ", "  ", "\t", "-", "é", "#", "", "_", "1", "\u00a0")) for _ in range(draw.randrange(6))) for _ in range(3000)]
    keys = [k for _, _, ks in dims.MERCHANTS for k in ks]
    patterns = ["|".join(f"(?:{p})" for p in dims.QRIS_PATTERNS), *[p for _, p, _ in dims.KIND_RULES]]
    begun = ["|".join(dims.QRIS_PATTERNS), *patterns[1:]]
    assert all(text.begun(p).startswith("(?=[") for p in begun)
    s = F.col("s")
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.upper(s), r"[^A-Z0-9\s.*/-]", " "), r"\s+", " "))
    found = lambda tree: F.regexp_extract_all(s, F.lit(f"(?=({tree}))"), F.lit(1))
    rows = spark.createDataFrame([(x,) for x in said], "s string").select(
        "s", (plain == text.normalize(s)).alias("same"), (found(text.tree_pattern(keys)) == found(text.places_pattern(keys))).alias("found"), F.array(*[s.rlike(p) == s.rlike(text.begun(b)) for p, b in zip(patterns, begun, strict=True)]).alias("kinds")
    )
    assert all(r.same and r.found and all(r.kinds) for r in rows.collect())
    assert re.fullmatch(text.places_pattern(["AB", "A", "CDE"]), "AB") and text.begun("TUNAI") == "TUNAI" and text.begun(r"\bA?B") == r"\bA?B"


def test_files_are_told_by_one_reading_of_their_lines(spark):
    """ingest_files makes each line and each balance once: events are read for the lines and for the headings, no more."""
    text = plan(registry.QUERIES["ingest_files"](spark, SF))
    reads = [line for line in text.splitlines() if "Relation [" in line]
    windows = [line for line in text.splitlines() if line.lstrip(" :+-").startswith("Window [")]
    assert len(reads) == 2 and len(windows) == 2 and "Join" not in text
    # where lines are only counted, neither texts nor balances are made
    counted = plan(registry.csv_lines(spark, SF, whole=False).groupBy("account_id", "file_idx").count())
    assert "Window" not in counted and "format_number" not in counted


def test_banks_are_those_of_plain_patterns(spark):
    """A signature is tried only where its letters are, and no bank is lost by that."""
    import random
    import re

    from pyspark.sql import functions as F

    from tallyspark.functions import dims, text, values

    draw = random.Random(4)
    signatures = [(p, w) for _, _, s in dims.BANKS for p, w in s]
    assert all(text.needed(p) for p, _ in signatures) and text.needed("neo|blu") == text.needed(r"\x41b") == [] and text.needed("abc?d*") == ["ab"]
    parts = [re.sub(r"\(\?i\)|\\b|\?", "", p).replace("\\s", draw.choice(("", " ", "\t"))).replace("\\+", "+") for p, _ in signatures]
    said = [" ".join(draw.choice((str, str.upper, str.title))(draw.choice(parts))[draw.choice((0, 0, 0, 1)) :] + draw.choice(("", "x", "\u0130", "\u212a", "\n")) for _ in range(draw.randrange(5))) for _ in range(1500)] + ["x" * 5995 + " BCA", "x" * 5995 + " flazz"]

    def plainly(found):
        found = iter(found)
        score, at = max((sum(w for _, w in s if next(found)), -at) for at, (_, _, s) in enumerate(dims.BANKS))
        return (*(dims.BANKS[-at][:2] if score else dims.GENERIC_BANK), min(1.0, score / 5))

    s = F.col("s")
    rows = spark.createDataFrame([(t,) for t in said], "s string").select(text.detect_bank(s).alias("b"), F.array(*[F.substring(s, 1, 6000).rlike(p) for p, _ in signatures]).alias("found")).collect()
    assert [tuple(r["b"]) for r in rows] == [plainly(r["found"]) for r in rows] and len({r["b"]["bank"] for r in rows}) == 10
    white = "".join(f"{w}{c}" for w in values.WHITE for c in ("a", " ", "\U0001f600"))
    assert spark.range(1).select(values.spaced(F.lit(white))).first()[0] == white.translate({ord(w): " " for w in values.WHITE})
    assert spark.range(1).select(text.detect_bank(F.lit(None).cast("string")).alias("b")).first()["b"]["bank"] == "generic"


def test_positioned_lines_are_made_once(spark):
    """ingest_lines writes its lines before several steps read them: events and balances are in none of these."""
    text = plan(registry.QUERIES["ingest_lines"](spark, SF))
    assert "user_id" not in text and "format_number" not in text
