"""Secret scans: candidates found by shape, false ones removed by a random forest. DataFrame functions only.

A candidate is each run of 16 or more of `[A-Za-z0-9+/_=-]` in a word `[^\\x20\\x09-\\x0D]+` of the whole text. Of a word
with more runs each one sees the text next to it: the run before and the marks up to the one after, NEAR characters at most.
Features: its length, transitions between letters, digits and cases, shares of digits, hexadecimal digits and
different characters, the share of its letters that words of a dictionary cover, marks of its word (quotes, @, dots,
slashes), what the two words before it and the one after it hold, and marks and depth of the row's path. The dictionary
is the corpus's own: the DICTIONARY most frequent words of WORD_SIZES letters, counted over all documents. The forest is
trained on labelled findings of all documents, at most MAX_FINDINGS of each label, and put into the query as one
expression of nested conditions, so that scanning neither shuffles nor leaves the row. A finding with half of the votes
or more is a secret; the labels' rule only teaches the forest, which also removes what that rule names. Where all findings
have one label there is no forest, and the rule decides. A string that is a secret at one place of a text is masked at all its places there. Masking goes by place.

Labels come from a finding's surroundings: 1 for a mixed letter-digit string that is assigned to a credential's name, with
or without quotes and spaces, also of a longer name (db_password, AWS_SECRET_ACCESS_KEY); else 0.

Null and empty texts have no findings; null paths count as empty. Without rules no candidate is a secret. Each row gives
one row, also a repeated one; ties among findings and words are broken by hash and by the word itself. An empty table
gives no rows. Columns n_candidates, secrets and redacted of the input give way to the new ones; others stay as they are.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from strandlens.llm.store import keep, table

MIN_LENGTH = 16
RUN = f"[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}"
NEAR = 64
MAX_FINDINGS = 20_000
TREES, DEPTH, SEED = 20, 5, 7
#: Words of the dictionary, and the least and most letters of one.
DICTIONARY, WORD_SIZES = 4096, (4, 12)
MASK = "[SECRET]"

#: Word parts where no dictionary is given, and words that announce a credential.
PARTS = "the and ing tion ent ion her for tha nth ter est ers ati hat ate all eth his ver ere con der die und sch ein ich den cht gen ung les que ment des ais our eur par ela los ado ido nte del aci est ara cion ede".split()
KEYS = "token|secret|passw(or)?d|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key"

#: A credential's name, alone or in a longer one. "author" and "tokenizer" aren't such.
NAME = f"[A-Za-z0-9_.-]*({KEYS})(s|key|[0-9]+)?([_.-][A-Za-z0-9]+){{0,8}}"
#: The rules of findings of one label: the label itself.
BY_LABEL = "label"

SHARES = ["digits", "hexes", "variety", "covered"]
FEATURES = ["length", "transitions", "case_changes", *SHARES, "quoted", "at_sign", "dots", "slashes", "key_before", "assigned", "key_inside", "after_plain", "path_depth", "path_test"]


def number(x: Column) -> Column:
    return F.coalesce(x.cast("double"), F.lit(0.0))


def pattern_of(words: list[str]) -> str:
    """One expression for all words, longer ones first; words that begin alike share their first two letters."""
    by: dict[str, list[str]] = {}
    for w in sorted(dict.fromkeys(words), key=lambda w: (-len(w), w)):
        by.setdefault(w[:2], []).append(w[2:])
    return "|".join(f"{k}(?:{'|'.join(v)})" for k, v in sorted(by.items())) or "(?!)"


def dictionary(docs: DataFrame, text: str = "text", size: int = DICTIONARY) -> str:
    """pattern_of the `size` most frequent words of all documents, ties by the word."""
    low, high = WORD_SIZES
    words = docs.select(F.explode(F.filter(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), "[^a-z]+"), lambda w: F.length(w).between(low, high))).alias("w"))
    found = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(size).collect()
    return pattern_of([r.w for r in found])


def candidate(words: Column, place: Column, j: Column, path: Column, parts: str) -> Column:
    """The struct of run j of the word at `place`: its text, FEATURES, label and the words about it."""
    i, runs, gaps = place["i"], place["runs"], place["gaps"]
    core, more = F.get(runs, j), F.size(runs) > 1
    near = lambda x, last: F.when(more, F.substring(x, -NEAR, NEAR) if last else F.substring(x, 1, NEAR)).otherwise(x)
    left = near(F.concat(F.when(j > 0, F.get(runs, j - 1)).otherwise(F.lit("")), F.get(gaps, j)), True)
    word = F.concat(left, core, near(F.get(gaps, j + 1), False))
    before = F.concat_ws(" ", F.when(i > 1, F.get(words, i - 2)), F.when(i > 0, F.get(words, i - 1)))
    after = F.coalesce(F.get(runs, j + 1), F.get(words, i + 1), F.lit(""))
    size = F.greatest(F.length(core), F.lit(1)).cast("double")
    share = lambda pattern: number(F.regexp_count(core, F.lit(pattern))) / size
    lowered = F.lower(core)
    features = {
        "length": F.length(core), "transitions": F.regexp_count(core, F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")), "case_changes": F.regexp_count(core, F.lit("[a-z](?=[A-Z])")),
        "digits": share("[0-9]"), "hexes": share("[0-9a-fA-F]"), "variety": F.size(F.array_distinct(F.split(lowered, ""))).cast("double") / size,
        "covered": (size - F.length(F.regexp_replace(lowered, parts, ""))) / size,
        "quoted": word.rlike("[\"'`]"), "at_sign": F.instr(word, "@") > 0, "dots": F.regexp_count(word, F.lit("[.]")), "slashes": F.regexp_count(word, F.lit("/")),
        "key_before": before.rlike(f"(?i)({KEYS})"), "assigned": before.rlike("[=:]\\W*$") | left.rlike("[=:]\\W*$") | word.rlike("^\\w+\\W*[=:]"), "key_inside": word.rlike(f"(?i)({KEYS})"),
        "after_plain": after.rlike("^[a-zA-Z,.]*$"), "path_depth": F.regexp_count(path, F.lit("/")), "path_test": path.rlike("(?i)(test|example|sample|fixture)"),
    }
    mixed = core.rlike("[0-9]") & core.rlike("[A-Za-z]")
    named = F.concat_ws(" ", before, left).rlike(f"(?i)(^|[^A-Za-z0-9_.-]){NAME}\\W*[=:]\\W*$")
    # a name, its sign and the value are one run where nothing stands between them
    inside = core.rlike(f"(?i)^{NAME}=+(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{{8,}}=*$")
    label = ((named & mixed) | inside).cast("double")
    return F.struct(label.alias("label"), core.alias("core"), word.alias("word"), before.alias("before"), *[number(features[k].cast("double") if k not in ("quoted", "at_sign", "key_before", "assigned", "key_inside", "after_plain", "path_test") else features[k].cast("int")).alias(k) for k in FEATURES])


def with_candidates(docs: DataFrame, text: str, path: str, parts: str | None = None) -> DataFrame:
    """`docs` with column __found, the array of its texts' candidates. Words are looked at by place, and only long ones are taken apart."""
    parts = parts or pattern_of(PARTS)
    docs = docs.withColumn("__words", F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"))
    word = lambda i: F.get(F.col("__words"), i)
    places = F.filter(F.sequence(F.lit(0), F.size("__words") - 1), lambda i: F.length(word(i)) >= MIN_LENGTH)
    places = F.filter(places, lambda i: word(i).rlike(RUN))
    places = F.transform(places, lambda i: F.struct(i.alias("i"), F.regexp_extract_all(word(i), F.lit(RUN), F.lit(0)).alias("runs"), F.split(word(i), RUN, -1).alias("gaps")))
    where = F.coalesce(F.col(path).cast("string"), F.lit(""))
    found = F.transform(places, lambda w: F.transform(F.sequence(F.lit(0), F.size(w["runs"]) - 1), lambda j: candidate(F.col("__words"), w, j, where, parts)))
    return docs.withColumn("__found", F.flatten(found)).drop("__words")


def labelled_findings(docs: DataFrame, text: str = "text", path: str = "source", max_findings: int = MAX_FINDINGS, parts: str | None = None) -> DataFrame:
    """Findings of all documents with their label; at most `max_findings` of each, those of smallest hash."""
    some = docs.select(F.col(text).alias("text"), F.col(path).alias("path"))
    # written once: taken apart in one plan, each field would have all candidates made again; outer, as a filter on the
    # array, which explode implies, would split the text again for each of its words
    rows = with_candidates(some, "text", "path", parts).select(F.explode_outer("__found").alias("c")).filter("c IS NOT NULL")
    rows = keep(rows, "candidates").select("c.*").distinct()
    part = lambda label: rows.filter(F.col("label") == label).orderBy(F.xxhash64("core", "before")).limit(max_findings)
    return part(1.0).union(part(0.0))


def conditions(description: str) -> str:
    """SQL for the share of trees that vote 1 for a candidate c, from the forest's printed rules."""
    lines = [x.strip() for x in description.splitlines()]
    votes, at = [], 0

    def node() -> str:
        nonlocal at
        line = lines[at]
        at += 1
        if line.startswith("Predict:"):
            return f"{float(line.split()[1])}D"
        k, value = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        yes = node()
        at += 1  # the Else line
        return f"IF(c.{FEATURES[int(k)]} <= {float(value)!r}D, {yes}, {node()})"

    while at < len(lines):
        at += 1
        if lines[at - 1].startswith("Tree "):
            votes.append(node())
    return f"({' + '.join(votes)}) / {len(votes)}D"


def train(findings: DataFrame) -> str | None:
    """The rules of a forest over labelled findings, BY_LABEL if one label is missing, None without findings."""
    findings = findings.persist()
    try:
        labels = findings.select("label").distinct().count()
        if labels < 2:
            return BY_LABEL if labels else None
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt", labelCol="label", featuresCol="features")
        return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(findings).select("features", "label")).toDebugString
    finally:
        findings.unpersist()


def learn(docs: DataFrame, text: str = "text", path: str = "source") -> tuple[str | None, str]:
    """The rules and the dictionary that scan() takes, learned from all of `docs`."""
    parts = dictionary(docs, text)
    return train(labelled_findings(docs, text, path, parts=parts)), parts


def scan(docs: DataFrame, rules: str | None, text: str = "text", path: str = "source", parts: str | None = None) -> DataFrame:
    """`docs` with n_candidates, secrets (the distinct strings, in order) and redacted (the text with each replaced by MASK)."""
    docs = docs.drop("n_candidates", "secrets", "redacted", "__words", "__found", "__made")
    found = with_candidates(docs, text, path, parts)
    if rules is None:
        secrets = F.array().cast("array<string>")
    else:
        votes = "c.label = 1D" if rules == BY_LABEL else f"{conditions(rules)} >= 0.5D"
        secrets = F.expr(f"array_distinct(transform(filter(__found, c -> {votes}), c -> c.core))")
    # behind a generator, so that what refers to the secrets doesn't look for them again
    made = F.explode(F.array(F.struct(F.size("__found").cast("long").alias("n_candidates"), secrets.alias("secrets"))))
    out = found.withColumn("__made", made).drop("__found").withColumns({k: F.col(f"__made.{k}") for k in ("n_candidates", "secrets")}).drop("__made")
    plain = F.col(text).cast("string")
    # a text's runs, of which the words' runs are made too, and what stands between them
    runs, gaps = F.regexp_extract_all(plain, F.lit(RUN), F.lit(0)), F.split(plain, RUN, -1)
    masked = F.transform(runs, lambda r, j: F.concat(F.get(gaps, j), F.when(F.array_contains("secrets", r), F.lit(MASK)).otherwise(r)))
    redacted = F.concat(F.array_join(masked, ""), F.element_at(gaps, -1))
    return out.withColumn("redacted", F.when(F.size("secrets") > 0, redacted).otherwise(plain))


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rules, parts = learn(docs)
    return scan(docs, rules, parts=parts).select("doc_id", "n_candidates", "secrets", F.sha2("redacted", 256).alias("redacted_sha256"))
