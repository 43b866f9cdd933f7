"""Secret scans by patterns and a battery of randomness tests, in SQL expressions alone.

Base: three patterns (an assignment to a telling name, an access key, a long hexadecimal run), found and measured in place.

Method: every long run of key-like characters is a candidate. Its encoding is inferred from its characters, and under that
encoding three tests ask whether it could be a random string: chi-squared against a uniform alphabet, the number of runs
above and below the middle of the alphabet, and the correlation of neighbouring symbols. Its p-value is the smallest of the
three, times three. Each candidate has a decoy of its own kind: the words of the text around it, in its length and encoding,
which are no secret but what names and words would look like there. In each class of length, candidates are accepted from the lowest p-value t on where the share of decoys at t and
above, among those of this length or shorter, foretells at most RATE false ones among the accepted. So short candidates, which
words resemble, must do better than long ones, and how much better the whole corpus says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import stored, table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
NAMES = ("passw", "secret", "token", "apikey", "api_key")
LEAST_VALUE = 6
#: Key-like runs, shortest length; false-discovery rate; bins of p-values; classes of length are of so many characters, the last takes all longer.
RUN, LEAST_RUN, RATE, BINS, CLASS, CLASSES = r"[A-Za-z0-9+/_-]{20,}={0,2}", 20, 0.05, 200, 8, 12
#: Alphabets of the encodings, in the order of their symbols' values.
DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = {
    "decimal": (DIGITS, r"^[0-9]+$"),
    "hex": (DIGITS + "abcdef", r"^([0-9a-f]+|[0-9A-F]+)$"),
    "base32": (LETTERS.upper() + "234567", r"^[A-Z2-7]+=*$"),
    "base36": (DIGITS + LETTERS, r"^([0-9a-z]+|[0-9A-Z]+)$"),
    "base64": (LETTERS.upper() + LETTERS + DIGITS + "+/", r"^[A-Za-z0-9+/_-]+=*$"),
}
KINDS = ("assign", "access", "hex", "random")
#: Integers in a block of a prefix sum; text around a candidate that its decoy is made of, in lengths of it on either side.
BLOCK, AROUND = 256, 4


def prefix_sums(x: Column) -> Column:
    """Sums of all elements before each one of an array of integers; in blocks, so that long arrays take near-linear time."""
    zero = F.struct(F.array().cast("array<bigint>").alias("sums"), F.lit(0).cast("long").alias("sum"))
    add = lambda a, v: F.struct(F.concat(a["sums"], F.array(a["sum"])).alias("sums"), (a["sum"] + v).alias("sum"))
    block = lambda b: F.slice(x, b * BLOCK + 1, F.lit(BLOCK))
    blocks = F.sequence(F.lit(0), F.floor((F.greatest(F.size(x), F.lit(1)) - 1) / BLOCK).cast("int"))
    totals = F.transform(blocks, lambda b: F.aggregate(block(b), F.lit(0).cast("long"), lambda a, v: a + v))
    bases = F.aggregate(totals, zero, add)["sums"]
    within = F.transform(blocks, lambda b: F.transform(F.aggregate(block(b), zero, add)["sums"], lambda s: s + F.get(bases, b)))
    return F.flatten(within)


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost non-overlapping matches: array of struct(start, end, value) in code points; value: the group's text.

    Starts come from the lengths of the matches and of what stands between them."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(hits)), lambda g: F.length(g).cast("long"))
    sizes = F.transform(hits, lambda h: F.length(h).cast("long"))
    ends = F.zip_with(prefix_sums(F.zip_with(gaps, sizes, lambda g, s: g + s)), F.arrays_zip(gaps.alias("g"), sizes.alias("s")), lambda p, z: F.struct((p + z["g"]).alias("start"), (p + z["g"] + z["s"]).alias("end")))
    return F.zip_with(ends, values, lambda e, v: F.struct(e["start"].alias("start"), e["end"].alias("end"), v.alias("value")))


NONE = "array<struct<start:bigint,end:bigint,value:string>>"


def where(present: Column, found: Column) -> Column:
    """found where a cheap test says that there is something to find, else nothing."""
    return F.when(present, found).otherwise(F.array().cast(NONE))


def base_spans(text: Column) -> list[Column]:
    """Matches of the three patterns as arrays assign, access and hex."""
    low = F.lower(text)
    names = low.contains(NAMES[0])
    for n in NAMES[1:]:
        names = names | low.contains(n)
    assign = F.filter(located(text, ASSIGN, 2), lambda m: F.length(m["value"]) >= LEAST_VALUE)
    return [where(names, assign).alias("assign"), where(text.contains("AKIA"), located(text, ACCESS)).alias("access"), where(text.rlike(HEX), located(text, HEX)).alias("hex")]


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal distribution (logistic approximation, off by 0.0002 at most)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.least(F.lit(700.0), F.lit(1.5976) * z + F.lit(0.07056) * z * z * z)))


def decoy_of(value: Column, near: Column) -> Column:
    """Ordinary text in the length and the encoding of a candidate; null if there is too little of it.

    Digits and hexadecimal ones stand for letters in turn of the alphabet, single-case encodings get letters of that case, and
    base64 gets words joined by underscores, as names are. Pieces of the text around that hold digits or signs of base64, which
    may be secrets themselves, are no ordinary text, nor are those that its ends cut off."""
    is_a = lambda name: value.rlike(ALPHABETS[name][1])
    plain = F.regexp_replace(near, r"^\S+|\S*[0-9+/=_]\S*|\S+$", " ")
    letters = F.lower(F.regexp_replace(plain, "[^A-Za-z]+", ""))
    joined = F.btrim(F.regexp_replace(plain, "[^A-Za-z]+", "_"), F.lit("_"))
    coded = lambda name: F.translate(letters, LETTERS, (ALPHABETS[name][0] * 3)[:26])
    cased = lambda x: F.when(value.rlike("[A-Z]"), F.upper(x)).otherwise(x)
    out = F.when(is_a("decimal"), coded("decimal")).when(is_a("hex"), cased(coded("hex"))).when(is_a("base32") | is_a("base36"), cased(letters)).otherwise(joined)
    return F.when(F.length(out) >= F.length(value), F.substr(out, F.lit(1), F.length(value)))


def battery(runs: DataFrame) -> DataFrame:
    """runs(value, ...) with encoding, n (symbols) and p added: the smallest p-value of the three tests, times three."""
    symbols = F.regexp_replace("value", "=+$", "")
    kind = F.lit("base64")
    for name in ("base36", "base32", "hex", "decimal"):
        kind = F.when(F.col("value").rlike(ALPHABETS[name][1]), F.lit(name)).otherwise(kind)
    out = runs.withColumn("encoding", kind).withColumn("s", F.translate(symbols, "-_", "+/"))
    out = out.withColumn("s", F.when(F.col("encoding").isin("hex", "base36"), F.lower("s")).otherwise(F.col("s")))
    alphabet, size = F.lit(ALPHABETS["base64"][0]), F.lit(64)
    for name in ("decimal", "hex", "base32", "base36"):
        alphabet, size = F.when(F.col("encoding") == name, F.lit(ALPHABETS[name][0])).otherwise(alphabet), F.when(F.col("encoding") == name, F.lit(len(ALPHABETS[name][0]))).otherwise(size)
    out = out.withColumn("alphabet", alphabet).withColumn("size", size.cast("double"))
    out = out.withColumn("n", F.length("s").cast("double")).withColumn("at", F.transform(F.split("s", ""), lambda c: F.instr(F.col("alphabet"), c).cast("double") - 1))
    # chi-squared, as a normal deviate
    square = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("size").cast("int")), lambda i: F.pow(F.col("n") - F.length(F.replace(F.col("s"), F.substr(F.col("alphabet"), i, F.lit(1)), F.lit(""))), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)
    chi, df = square * F.col("size") / F.col("n") - F.col("n"), F.col("size") - 1
    z1 = (F.cbrt(F.greatest(chi, F.lit(0.0)) / df) - (1 - F.lit(2.0) / (9 * df))) / F.sqrt(F.lit(2.0) / (9 * df))
    # runs above and below the middle
    out = out.withColumn("z1", z1).withColumn("high", F.transform("at", lambda a: F.when(a >= F.col("size") / 2, 1.0).otherwise(0.0)))
    out = out.withColumn("ones", F.aggregate("high", F.lit(0.0), lambda a, x: a + x)).withColumn("zeros", F.col("n") - F.col("ones"))
    changes = F.aggregate(F.zip_with(F.slice("high", F.lit(1), F.greatest(F.size("high") - 1, F.lit(0))), F.slice("high", F.lit(2), F.greatest(F.size("high") - 1, F.lit(0))), lambda a, b: F.abs(a - b)), F.lit(1.0), lambda a, x: a + x)
    mean = F.lit(2.0) * F.col("ones") * F.col("zeros") / F.col("n")
    spread = mean * (mean - 1) / (F.col("n") - 1)
    z2 = F.when(spread > 0, F.abs(changes - mean - 1) / F.sqrt(spread)).otherwise(F.lit(99.0))
    # correlation of neighbours
    out = out.withColumn("z2", z2).withColumn("mid", F.aggregate("at", F.lit(0.0), lambda a, x: a + x) / F.col("n"))
    dev = F.aggregate("at", F.lit(0.0), lambda a, x: a + (x - F.col("mid")) * (x - F.col("mid")))
    both = F.aggregate(F.zip_with(F.slice("at", F.lit(1), F.greatest(F.size("at") - 1, F.lit(0))), F.slice("at", F.lit(2), F.greatest(F.size("at") - 1, F.lit(0))), lambda a, b: (a - F.col("mid")) * (b - F.col("mid"))), F.lit(0.0), lambda a, x: a + x)
    out = out.withColumn("dev", dev).withColumn("z3", F.when(F.col("dev") > 0, F.abs(both / F.col("dev") + 1 / F.col("n")) * F.sqrt("n")).otherwise(F.lit(99.0)))
    p = F.least(normal_tail(F.col("z1")), 2 * normal_tail(F.col("z2")), 2 * normal_tail(F.col("z3"))) * 3
    return out.withColumn("p", F.least(F.lit(1.0), p)).drop("s", "alphabet", "size", "at", "high", "ones", "zeros", "mid", "dev", "z1", "z2", "z3")


def thresholds(tested: DataFrame, rate: float = RATE) -> DataFrame:
    """tested(class, bin, decoy) of all runs to (class, least): the lowest bin from which candidates of the class are accepted.

    A table of CLASSES * BINS counts at most, whatever the corpus holds."""
    counts = tested.groupBy("class", "bin").agg(F.sum(F.col("decoy").cast("long")).alias("d"), F.sum((~F.col("decoy")).cast("long")).alias("c"))
    spark = tested.sparkSession
    grid = spark.range(CLASSES).select(F.col("id").cast("int").alias("class")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(BINS))))
    counts = grid.join(counts, ["class", "bin"], "left").fillna(0, ["d", "c"])
    up = Window.partitionBy("class").orderBy(F.col("bin").desc())
    shorter = Window.partitionBy("bin").orderBy("class")
    counts = counts.withColumn("d_up", F.sum("d").over(up)).withColumn("c_up", F.sum("c").over(up))
    counts = counts.withColumn("d_up", F.sum("d_up").over(shorter)).withColumn("d_all", F.max("d_up").over(Window.partitionBy("class"))).withColumn("c_all", F.max("c_up").over(Window.partitionBy("class")))
    false = (F.col("d_up") + 1) / (F.col("d_all") + 1) * F.col("c_all")
    return counts.filter((F.col("c_up") > 0) & (false <= F.lit(rate) * F.col("c_up"))).groupBy("class").agg(F.min("bin").alias("least"))


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """docs(doc_id, text) to doc_id, assign, access, hex (arrays of struct(start, end, value)) and random, with encoding and p.

    Starts and ends count code points, ends exclusive. A null text is empty; repeated rows are documents of their own; null
    doc_ids stay; other columns are ignored; an empty table gives an empty one. Spans of the method never overlap base ones."""
    text = F.coalesce("text", F.lit(""))
    size = lambda r: (r["end"] - r["start"]).cast("int") * AROUND
    near = lambda r: F.concat(F.substr(text, (F.greatest(r["start"] - size(r), F.lit(0)) + 1).cast("int"), F.least(size(r), r["start"].cast("int"))), F.substr(text, (r["end"] + 1).cast("int"), size(r)))
    runs = F.transform(where(text.rlike(RUN), located(text, RUN)), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["value"].alias("value"), near(r).alias("near")))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("uid"), *base_spans(text), runs.alias("runs"))
    rows = stored(rows, "scanned")
    runs = rows.filter(F.size("runs") > 0).select("uid", F.array_sort(F.flatten(F.transform(F.array("assign", "access", "hex"), lambda a: F.transform(a, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))))).alias("base"), F.explode("runs").alias("run")).select("uid", "base", "run.*")
    both = F.array(F.struct(F.lit(False).alias("decoy"), F.col("value")), F.struct(F.lit(True).alias("decoy"), decoy_of(F.col("value"), F.col("near")).alias("value")))
    runs = runs.select("uid", "base", "start", "end", F.inline(both)).filter(F.col("value").isNotNull())
    runs = battery(runs).withColumn("class", F.least(F.lit(CLASSES - 1), F.floor((F.col("n") - LEAST_RUN) / CLASS)).cast("int")).withColumn("class", F.greatest(F.col("class"), F.lit(0))).withColumn("bin", F.floor(F.col("p") * BINS).cast("int"))
    runs = stored(runs.select("uid", "start", "end", "value", "encoding", "p", "class", "bin", "decoy", "base"), "tested")
    passed = runs.filter(~F.col("decoy") & ~F.exists("base", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"])))
    # thresholds: at most CLASSES rows
    passed = passed.join(F.broadcast(thresholds(runs.select("class", "bin", "decoy"), rate)), "class").filter(F.col("bin") >= F.col("least"))
    found = passed.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "end", "value", "encoding", "p"))).alias("random"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string,encoding:string,p:double>>")
    return rows.join(found, "uid", "left").select("doc_id", "assign", "access", "hex", F.coalesce("random", empty).alias("random"))


def listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans of these columns, by start, then kind in the order of KINDS."""
    def spans(kind: str) -> Column:
        return F.transform(F.col(kind), lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")))

    each = [spans(k) for k in kinds]
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(F.concat(*each)), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of base spans in all documents, the digest of their list, and the list of all spans."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    sizes = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *sizes, F.sha2(listed(KINDS[:3]), 256).alias("base_sha256"), listed(KINDS).alias("spans"))
