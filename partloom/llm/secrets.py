"""Secret scans: candidates by pattern, a random forest against false positives, all in DataFrame functions.

A candidate is a run of about MIN_LENGTH key-like characters or more that holds a digit, without a `name=` before it and
the dots after it, an issuer's fixed form, or any value of at least 8 characters assigned to a secret's name. Documents
without one are passed over by a single pattern; the rest are cut at their candidates, which gives each its place and its
neighbours. Features of a candidate: its length, transitions between classes of characters, variety, the share of it that
is covered by a dictionary, whether it looks like a path, address, number or issued key, and the words beside it. The
dictionary is learned: the letter triples of the corpus's DICTIONARY most frequent words. A random forest (pyspark.ml) trained
on labelled findings then says which candidates are secrets.

Labelled findings are a table (the columns of `findings` and `label`). Where a caller has none, planted() makes them: known
secrets and known look-alikes (numbers, addresses, paths, digests and versions under harmless names, placeholders and plain
words under secrets' names) between words of at most max_planted of the corpus's own documents, cut out by the same
patterns; the labels come from what was planted, not from a rule over the features. At most max_train labelled findings
are used, in the order of a hash.

Nulls: a null text has no findings; a null doc_id is kept. Repeated rows give their findings each. Where the labelled
findings lack a class, nothing is a secret, or all candidates are. An empty table gives no findings.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, numbered, split_words, stash

MIN_LENGTH = 16
#: Names that secrets are assigned to, and the forms of well-known issuers' keys.
NAMES = r"(?i)(token|secret|passw(or)?d|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key)"
ISSUED = r"(?<![A-Za-z0-9])(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[baprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_=-]+\.[A-Za-z0-9_=-]+\.)"
HARMLESS = r"(?i)^(commit|sha-?[0-9]*|md5|hash|digest|checksum|etag|uuid|guid|version|revision|build|order|invoice|phone|isbn|date|file|path|url)$"
#: Possessive runs: Java doesn't go back into them. The look-ahead asks for a digit; an equals sign may only close a run.
RUN = rf"(?<![A-Za-z0-9_+/.@-])(?=[A-Za-z_+/.@-]*+[0-9])(?=[A-Za-z0-9_+/.@=-]{{{MIN_LENGTH}}})[.@]*+[A-Za-z0-9_+/-]++(?:[.@]++[A-Za-z0-9_+/-]++)*+(?:={{1,2}}(?![A-Za-z0-9_+/=.@\"'-]))?+(?!=)"
#: What is assigned to a secret's name. The short look-behind passes over most places.
VALUE = r"[^\s\"'`<>(){}\[\],;&"
ASSIGNED = rf"(?<=[=:]>?\s{{0,2}}[\"']?)(?<={NAMES}[A-Za-z0-9_-]{{0,20}}[\"']?\s{{0,2}}[:=]{{1,2}}>?\s{{0,2}}[\"']?)(?![A-Za-z]+://){VALUE}=:]{VALUE}]{{6,}}{VALUE}.:!?]"
CANDIDATE = f"{ASSIGNED}|{ISSUED}|{RUN}"
DICTIONARY = 300
FEATURES = ["length", "transitions", "variety", "known_share", "digit_share", "upper_share", "hex", "numeric", "path", "address", "quoted", "assigned", "named", "harmless", "issued"]


def _left(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def dictionary(docs: DataFrame) -> str:
    """A pattern that matches before every letter triple of the corpus's DICTIONARY most frequent words of three letters or more."""
    words = docs.select(F.explode(split_words(lower_ascii(F.col("text")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    top = words.filter(F.col("word").rlike(r"^\p{L}{3,}$")).orderBy(F.desc("n"), "word").limit(DICTIONARY).collect()  # DICTIONARY rows
    triples = sorted({r.word[i : i + 3] for r in top for i in range(len(r.word) - 2)})
    return f"(?=({'|'.join(triples)}))" if triples else "(?!)"


def findings(docs: DataFrame, known: str, *more: str) -> DataFrame:
    """doc_id, start (in code points), candidate, before, after, the features and the columns in more, one row per candidate.

    Only the 60 characters on each side of a candidate reach its row. known: a pattern from dictionary().
    """
    some = docs.filter(F.col("text").rlike(CANDIDATE))
    # Cut at the candidates: parts are what stands between them.
    text = F.col("text")
    cut = some.select(*more, F.col("doc_id").cast("long"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split(text, CANDIDATE).alias("parts"))
    sizes = F.transform("found", lambda c, i: F.length(c) + F.length(F.element_at("parts", i + 1)))
    around = F.transform(
        "found",
        lambda c, i: F.struct(
            (F.aggregate(F.slice(F.col("sizes"), F.lit(1), i), F.lit(0), lambda a, n: a + n) + F.length(F.element_at("parts", i + 1))).cast("long").alias("start"),
            c.alias("candidate"),
            F.substring(F.element_at("parts", i + 1), -60, 60).alias("before"),
            F.substring(F.element_at("parts", i + 2), 1, 60).alias("after"),
        ),
    )
    rows = cut.withColumn("sizes", sizes).select(*more, "doc_id", F.inline(around))
    return with_features(rows, known)


def with_features(rows: DataFrame, known: str) -> DataFrame:
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "\u0002"), "[a-z]", "\u0003"), "[A-Z]", "\u0004"), "[^\u0002-\u0004]", "\u0005")
    runs = F.length(F.regexp_replace(kinds, "(.)\\1*", "x"))
    beside = F.regexp_extract("before", r"(\S*?)[\s\"'=:>]*$", 1)
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    values = {
        "length": n, "transitions": (runs - 1) / n, "variety": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(40.0)),
        "known_share": F.regexp_count(lower_ascii(c), F.lit(known)) / F.greatest(n - 2, F.lit(1.0)), "digit_share": 1 - _left(c, "[0-9]") / n, "upper_share": 1 - _left(c, "[A-Z]") / n,
        "hex": flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")), "numeric": flag(c.rlike("^[0-9.+/=_-]+$")), "path": flag(c.rlike("/[^/]*/|[.][a-z]{2,4}$")),
        "address": flag(c.rlike("@")), "quoted": flag(F.col("before").rlike("[\"']$")), "assigned": flag(F.col("before").rlike("[=:]>?\\s*[\"']?$")),
        "named": flag(beside.rlike(NAMES)), "harmless": flag(beside.rlike(HARMLESS)), "issued": flag(c.rlike(ISSUED)),
    }
    return rows.withColumns({k: v.cast("double") for k, v in values.items()})


#: What is planted: (label, what stands before, the secret or look-alike, what follows). {hex}, {mix}, {caps}, {letters} and
#: {digits} stand for characters drawn by a hash, {name} for a secret's name, {sep} for a sign of assignment, {a} and {b} for
#: the document's words.
SECRET_NAMES = ["token", "secret", "password", "api_key", "apiKey", "access_key", "client_secret", "auth_token", "private-key", "DB_PASSWORD", "passwd", "credential"]
SIGNS = [(' = "', '"'), ("=", ""), (": ", ""), ("='", "'"), (': "', '"'), (" => ", "")]
PLANTED = [
    (1, "{name}{sep}", "{hex40}", "{end}"), (1, "{name}{sep}", "{hex18}", "{end}"), (1, "{name}{sep}", "{mix24}", "{end}"), (1, "{name}{sep}", "{mix40}", "{end}"), (1, "{name}{sep}", "{letters24}", "{end}"),
    (1, "{name}{sep}", "{a}{digits4}{b}", "{end}"), (1, "{name}{sep}", "{mix12}", "{end}"), (1, "", "AKIA{caps16}", ""), (1, "key ", "AKIA{caps16}", "."), (1, "{name}{sep}", "AKIA{few16}", "{end}"), (1, "", "ghp_{few36}", ""), (1, "", "ghp_{mix36}", ""), (1, "", "ghp_{letters36}", ""), (1, "{name}{sep}", "sk_live_{mix24}", "{end}"),
    (1, "", "xoxb-{digits12}-{mix24}", ""), (1, "", "AIza{mix35}", ""), (1, "Bearer ", "eyJ{mix20}.eyJ{mix32}.{mix40}", ""),
    (0, "", "{digits16}", ""), (0, "order ", "{digits14}", ""), (0, "phone: ", "+{digits14}", ""), (0, "", "{a}.{digits2}@mail{digits1}.example.com", ""), (0, "url=", "www.{a}.org/{b}/{digits8}/index.html", ""),
    (0, "", "/usr/{a}/{b}_{digits3}/file.txt", ""), (0, "commit ", "{hex40}", ""), (0, "sha1: ", "{hex40}", ""), (0, "checksum=", "{hex32}", ""), (0, 'etag="', "{hex32}", '"'), (0, "uuid ", "{hex8}-{hex4}-{hex4}-{hex4}-{hex12}", ""),
    (0, "version ", "1.{digits1}.{digits2}-alpha.{digits8}", ""), (0, "date ", "2024-01-{digits2}T{digits2}:{digits2}", ""), (0, "{name}{sep}", "{a}_{b}_{a}", "{end}"), (0, "{name}{sep}", "{a}-{b}-here", "{end}"), (0, "{name}{sep}", "xxxxxxxxxxxxxxxx", "{end}"),
    (0, "{name}{sep}", "0000000000000000", "{end}"), (0, "{name}{sep}", "your_token_here", "{end}"), (0, "{name}{sep}", "EXAMPLE_EXAMPLE_1", "{end}"), (0, "{name}{sep}", "{a}{b}{a}{b}", "{end}"), (0, "", "{a}{digits2}{b}{digits2}{a}{b}", ""),
]


def _drawn(kind: str, n: int, seed: Column) -> Column:
    """n characters of a kind, drawn by a hash of seed."""
    hexes = F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("2")), 256))
    if kind == "hex":
        return F.substring(hexes, 1, n)
    if kind == "few":  # of six characters only
        return F.substring(F.translate(hexes, "0123456789abcdef", "Q7X2KMQ7X2KMQ7X2"), 1, n)
    if kind == "digits":
        return F.substring(F.translate(hexes, "abcdef", "135790"), 1, n)
    coded = F.concat(F.base64(F.unhex(hexes)), F.base64(F.unhex(F.sha2(F.concat(seed, F.lit("3")), 256))))
    if kind == "caps":
        return F.substring(F.upper(F.translate(coded, "+/=019", "QZXKLM")), 1, n)
    return F.substring(F.translate(coded, "+/=0123456789" if kind == "letters" else "+/=", "QzXkLmbRtYuHj" if kind == "letters" else "Qz7"), 1, n)


def _filled(template: str, values: dict[str, Column], seed: Column) -> Column:
    parts = []
    for i, part in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2 == 0:
            parts.append(F.lit(part))
        elif part in values:
            parts.append(values[part])
        else:
            kind, n = re.fullmatch(r"([a-z]+)(\d+)", part).groups()
            parts.append(_drawn(kind, int(n), F.concat(seed, F.lit(f"{template}{i}"))))
    return F.concat(*parts)


def planted(docs: DataFrame, known: str, max_planted: int = 400, seed: int = 17) -> DataFrame:
    """Labelled findings: everything in PLANTED between words of at most max_planted documents, the first in the order of a hash."""
    word = lambda i: F.coalesce(F.nullif(F.regexp_replace(F.regexp_extract("text", r"(?s)^\s*" + r"\S+\s+" * i + r"(\S+)", 1), r"[^\p{L}]", ""), F.lit("")), F.lit("word"))
    chosen = docs.select("doc_id", "text").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_planted)
    rows = stash(chosen.select(F.monotonically_increasing_id().alias("n"), *(F.substring(word(i), 1, 12).alias(f"w{i}") for i in range(4))))
    own = F.concat(F.col("n").cast("string"), F.lit(f":{seed}:"))
    pick = lambda values, salt: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64("n", F.lit(salt)), F.lit(len(values))) + 1).cast("int"))
    made = []
    for k, (label, before, middle, after) in enumerate(PLANTED):
        values = {"a": F.col("w1"), "b": F.col("w2"), "name": pick(SECRET_NAMES, 3 * k), "sep": pick([a for a, _ in SIGNS], 3 * k + 1), "end": pick([b for _, b in SIGNS], 3 * k + 1)}
        text = F.concat_ws(" ", "w0", F.concat(_filled(before, values, own), _filled(middle, values, own), _filled(after, values, own)), "w3")
        made.append(F.struct(F.lit(label).alias("label"), _filled(middle, values, own).alias("secret"), text.alias("text")))
    some = [rows.select(F.col("n").alias("doc_id"), F.inline(F.array(*made[k : k + 5]))) for k in range(0, len(made), 5)]  # a few at a time: generated code has a size
    texts = stash(reduce(DataFrame.unionByName, some))
    found = findings(texts, known, "label", "secret")
    return found.withColumn("label", ((F.col("label") == 1) & (F.col("candidate") == F.col("secret"))).cast("double")).drop("secret")


def forest(labelled: DataFrame, max_train: int = 20_000, trees: int = 40, depth: int = 8, seed: int = 17):
    """The fitted forest, or the only label where a class is missing (0 without labels)."""
    picked = labelled.orderBy(F.xxhash64("candidate", "before"), "candidate", "before", "after", "doc_id", "start").limit(max_train)
    train = stash(picked.select("label", *FEATURES))
    low, high = train.agg(F.min("label"), F.max("label")).first()
    if low == high:
        return float(low or 0.0)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(train.coalesce(1))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label").fit(vectors)


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, cut: float = 0.5, among: DataFrame | None = None, **options) -> DataFrame:
    """Every candidate: doc_id, start, candidate, before, after, FEATURES, score and is_secret.

    among: those of docs that may hold a candidate, where that is known already.
    """
    dictionary_of = dictionary(docs)
    rows = stash(findings(docs if among is None else among, dictionary_of))
    known = planted(docs, dictionary_of) if labelled is None else labelled
    model = forest(known, **options)
    if isinstance(model, float):
        return rows.withColumn("score", F.lit(model)).withColumn("is_secret", F.col("score") >= cut)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    scored = model.transform(vectors).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "start", "candidate", "before", "after", *FEATURES, "score", (F.col("score") >= cut).alias("is_secret"))


def redact_secrets(docs: DataFrame, placeholder: str = "[SECRET]", **options) -> DataFrame:
    """docs with every secret in `text` replaced; other columns and rows stay, n_chars follows the text where present.

    Only texts that hold a candidate meet their spans; the others aren't shuffled.
    """
    may = F.coalesce(F.col("text").rlike(CANDIDATE), F.lit(False))
    rows = numbered(docs.select(F.struct(*docs.columns).alias("doc"), may.alias("__may")), "__row").withColumn("text", F.col("doc.text"))
    some, texts = rows.filter("__may"), (F.col("__row").alias("doc_id"), "text")
    hits = scan_secrets(rows.select(*texts), among=some.select(*texts), **options).filter("is_secret")
    spans = hits.groupBy(F.col("doc_id").alias("__row")).agg(F.array_sort(F.collect_list(F.struct("start", F.length("candidate").alias("size")))).alias("__spans"))
    step = lambda a, s: F.struct(
        F.concat(a["done"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(placeholder)).alias("done"),
        (s["start"] + s["size"]).cast("long").alias("at"),
    )
    built = F.aggregate("__spans", F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at")), step, lambda a: F.concat(a["done"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.lit(2147483647))))
    met = some.join(spans, "__row", "left").unionByName(rows.filter("not __may"), allowMissingColumns=True)
    out = met.withColumn("text", F.when(F.col("__spans").isNotNull(), built).otherwise(F.col("text")))
    size = F.when(F.col("__spans").isNotNull(), F.length("text")).otherwise(F.col("doc.n_chars") if "n_chars" in docs.columns else F.lit(0))
    new = {"text": F.col("text"), "n_chars": size}
    return out.select(*((new[c].cast(docs.schema[c].dataType) if c in new else F.col("doc").getField(c)).alias(c) for c in docs.columns))
