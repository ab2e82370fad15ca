"""Secret scans: candidates by pattern, false positives removed by a random forest, in DataFrame functions only.

A candidate is a long run of key characters in a word, or a shorter value of any characters that is assigned to a name of
secrets. Its features are its length, the transitions between its character classes, how much of it words of a dictionary
cover, what of a path the word looks like, and the words around it. The dictionary holds the corpus' most frequent words,
counted over all documents. The forest (Spark's own, trained by seed) learns from labelled findings: any DataFrame in the
form of ``candidates`` with a label. ``labelled_findings`` makes such a set: into places of a bounded sample of the
documents' own texts it writes keys in the forms that services issue, and what scanners mistake for them, much of that made
of the same texts' words. Every row names its form, so that whole forms can be held out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specula.llm.common import LOWER, UPPER, written

KEY = "[A-Za-z0-9+/_=-]"
#: Least lengths of a run of key characters, and of a value assigned to a name of secrets.
LEAST_RUN, LEAST_VALUE = 16, 8
#: Words of the dictionary: the most frequent ones of the corpus, of so many letters.
DICTIONARY_WORDS, WORD_LETTERS = 2000, (3, 12)
#: Findings that a forest is trained on at most (an expected number, chosen by hash), and texts that labelled findings are made
#: of. Trees, depth and seed of the forest.
TRAINING_ROWS, LABELLED_ROWS, TREES, DEPTH, SEED = 20_000, 6_000, 30, 8, 7
FEATURES = (
    "length digits uppers symbols hexes transitions vowels longest_run distinct coverage slashes dots url extension hyphens"
    " before_secret before_benign after_benign assigned quoted inside_secret"
).split()

# Words that name secrets, and words that name what is none.
SECRET_WORDS = "token secret password passwd pwd apikey api_key api-key key auth bearer credential credentials access private signing".split()
BENIGN_WORDS = (
    "commit sha sha1 sha256 md5 hash checksum digest uuid guid revision etag integrity build version example sample dummy test"
    " placeholder page file path url href image session trace request order invoice isbn"
).split()


def _names(words: list[str]) -> str:
    return "(?i)(^|[^a-z0-9])(" + "|".join(sorted(words, key=len, reverse=True)) + ")s?([^a-z0-9]|$)"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_run: int = LEAST_RUN, least_value: int = LEAST_VALUE) -> DataFrame:
    """(id, word_no, nth, candidate, word, before, after): every candidate of every whole text.

    Words end at white space. A candidate is a run of least_run or more key characters that has letters and digits, or that a
    sign of assignment in its word or the word before introduces; or a value of least_value or more characters other than
    quotes, commas, semicolons and brackets, with a character that is no letter, behind such a sign and a name of secrets.
    A value takes the place of the runs within it. nth counts the candidates of a word. before holds the three words in
    front, after the next two. Null and empty texts have none. Repeated rows give repeated findings, an empty table none.
    """
    run, value = KEY + "{" + str(least_run) + ",}", r"[^\s\"'`,;()\[\]{}<>]{" + str(least_value) + ",}"
    sign, names = r"[=:][\"'`]*$", _names(SECRET_WORDS)
    # The name may be in the word itself, with quotes, or in the words before.
    inline = "(?i)(?:" + "|".join(sorted(SECRET_WORDS, key=len, reverse=True)) + r")s?[\"'`]?[=:][\"'`]*" + value
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\\s+").alias("words"))
    get = lambda i: F.coalesce(F.get("words", i), F.lit(""))
    front = lambda i: F.concat_ws(" ", F.get("words", i - 3), F.get("words", i - 2), F.get("words", i - 1))
    named = lambda i: get(i - 1).rlike(sign) & get(i).rlike(value) & front(i).rlike(names)
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: get(i).rlike(run) | get(i).rlike(inline) | named(i))
    at = F.col("word_no")
    found = rows.select("id", "words", F.explode(places).alias("word_no")).select(
        "id", "word_no", get(at).alias("word"), front(at).alias("before"), F.concat_ws(" ", F.get("words", at + 1), F.get("words", at + 2)).alias("after")
    )
    behind = F.col("before").rlike(sign)
    first = F.regexp_extract("word", f"({value})", 1)
    assigned = F.when(F.col("word").rlike(inline), F.regexp_extract("word", r"[=:][\"'`]*(" + value + ")", 1)).when(behind & F.col("before").rlike(names), first)
    assigned = F.when(assigned.rlike("[^A-Za-z]"), assigned)
    mixed = lambda c: c.rlike("[0-9]") & c.rlike("[A-Za-z]")
    introduced = behind | F.col("word").rlike("[=:][\"'`]*" + run)
    runs = F.filter(F.regexp_extract_all("word", F.lit(f"({run})"), F.lit(1)), lambda c: mixed(c) | introduced)
    found = found.withColumn("value", assigned).withColumn("runs", runs)
    whole = F.concat(F.array("value"), F.filter("runs", lambda c: ~F.contains(F.col("value"), c)))
    found = found.select("id", "word_no", F.posexplode(F.when(F.col("value").isNull(), F.col("runs")).otherwise(whole)).alias("nth", "candidate"), "word", "before", "after")
    return found.select("id", "word_no", "nth", "candidate", "word", "before", "after")


def dictionary(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY_WORDS) -> list[str]:
    """The ``size`` most frequent words of all texts, ties by the alphabet; words of secrets and of what is none are added.

    Counted before the shuffle; what reaches the driver is the list. A corpus without words gives the fixed words only.
    """
    low, high = WORD_LETTERS
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"\b([a-z]{%d,%d})\b" % (low, high)), F.lit(1))).alias("w"))
    top = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(size)
    fixed = [w for w in SECRET_WORDS + BENIGN_WORDS if w.isalpha() and len(w) >= low]
    return sorted({r["w"] for r in top.collect()} | set(fixed))


def _trie(words: list[str]) -> str:
    """A pattern of the longest of the words that starts at a place; it looks at each letter once."""
    ends, heads = "" in words, sorted({w[0] for w in words if w})
    if not heads:
        return ""
    inner = "|".join(h + _trie([w[1:] for w in words if w[:1] == h]) for h in heads)
    return f"(?:{inner})" + ("?" if ends else "")


def features(found: DataFrame, words: list[str]) -> dict[str, Column]:
    """The features by name, as expressions over the columns of ``candidates``; none is ever null or NaN. Null columns count
    as empty texts. words: a dictionary."""
    c, word, before, after = (F.coalesce(found[x], F.lit("")) for x in ("candidate", "word", "before", "after"))
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    classes = F.regexp_replace(F.translate(c, LOWER + UPPER + "0123456789", "a" * 26 + "A" * 26 + "0" * 10), "[^aA0]", "-")
    runs = F.regexp_replace(classes, "(.)\\1+", "$1")
    share = lambda pattern: (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))) / n
    truth = lambda x: x.cast("double")
    count = lambda sign: F.least(F.length(word) - F.length(F.replace(word, F.lit(sign), F.lit(""))), F.lit(9)).cast("double")
    lead = F.call_function("substring_index", word, c, F.lit(1))  # what of the word stands before the candidate
    letters = F.transform(F.regexp_extract_all(c, F.lit("([A-Za-z]+)"), F.lit(1)), lambda x: F.length(x))
    alone = lead.rlike("^[^A-Za-z0-9]*$")
    out = {
        "length": n,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "symbols": share("[^A-Za-z0-9]"),
        "hexes": share("[0-9a-fA-F]"),
        "transitions": F.greatest(F.length(runs) - 1, F.lit(0)) / n,
        "vowels": share("[aeiouAEIOU]"),
        "longest_run": F.coalesce(F.array_max(letters), F.lit(0)) / n,
        "distinct": F.size(F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))) / n,
        "coverage": (F.length(c) - F.length(F.regexp_replace(F.lower(c), _trie(words), ""))) / n if words else F.lit(0.0),
        "slashes": count("/"),
        "dots": count("."),
        "url": truth(word.rlike("://|^www\\.|@|data:")),
        "extension": truth(word.rlike("\\.[a-zA-Z]{1,4}[\"',;)]*$")),
        "hyphens": share("-"),
        "before_secret": truth(before.rlike(_names(SECRET_WORDS))),
        "before_benign": truth(before.rlike(_names(BENIGN_WORDS))),
        "after_benign": truth(after.rlike(_names(BENIGN_WORDS))),
        "assigned": truth(lead.rlike("[=:][\"'`]*$") | (alone & before.rlike("[=:][\"'`]*$"))),
        "quoted": truth(lead.rlike("[\"'`]$")),
        "inside_secret": truth(lead.rlike(_names(SECRET_WORDS))),
    }
    return {name: out[name] for name in FEATURES}


def labelled_findings(docs: DataFrame, text_col: str = "text", n: int = LABELLED_ROWS) -> DataFrame:
    """(form, label, candidate, word, before, after): label 1 for keys, 0 for their look-alikes, about n of them.

    Each is written into a place of a distinct text of docs, chosen by the text's hash; the words around are the text's own,
    and so are those that slugs, paths and placeholders are made of. Texts of fewer than eight words give none.
    """
    texts = docs.select(F.col(text_col).alias("t")).filter("t IS NOT NULL").select("t", F.xxhash64("t").alias("h"))
    total = texts.count()
    texts = texts.filter(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < min(1.0, n / max(total, 1)) * (1 << 20)).dropDuplicates(["h"])
    h = F.col("h")
    draw = lambda k, m: F.pmod(F.xxhash64(h, F.lit(k)), m if isinstance(m, Column) else F.lit(m)).cast("int")
    pick = lambda values, k: F.get(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), draw(k, len(values)))
    words = F.split(F.trim("t"), "\\s+")
    rows = texts.select("h", words.alias("w")).filter(F.size("w") >= 8).withColumn("p", draw(1, F.size("w") - 7) + 3)
    plain = F.filter(F.transform(F.slice("w", draw(2, F.size("w") - 7) + 1, 8), lambda x: F.lower(F.regexp_replace(x, "[^A-Za-z]", ""))), lambda x: F.length(x) > 1)
    digest = lambda k: F.sha2(F.concat(F.lit(f"{k}:"), h.cast("string")).cast("binary"), 256)
    rows = rows.select(
        "h", F.get("w", F.col("p") - 2).alias("b2"), F.get("w", F.col("p") - 1).alias("b1"), F.concat_ws(" ", F.get("w", F.col("p")), F.get("w", F.col("p") + 1)).alias("after"),
        plain.alias("own"), digest(4).alias("x"), F.translate(F.base64(F.unhex(F.concat(digest(5), digest(6)))), "+/=\r\n", "Qz").alias("d"),
        pick([w for w in SECRET_WORDS if len(w) > 2], 7).alias("name"), pick(BENIGN_WORDS, 8).alias("benign"), draw(9, 20).alias("size"), draw(10, 2).alias("coin"),
        pick(["=", ":"], 11).alias("sign"), pick(['"', "'", ""], 12).alias("quote"), draw(13, len(FORMS)).alias("form"),
    )
    rows = written(rows.withColumn("name", F.when(draw(14, 4) == 0, F.upper("name")).otherwise(F.col("name"))), "labelled")
    made = {name: make() for name, make in FORMS.items()}
    chosen = lambda k: reduce(lambda w, x: w.when(F.col("form") == x[0], x[1][k]), enumerate(made.values()), F).otherwise(F.lit(None))
    out = rows.select(
        F.get(F.array(*map(F.lit, FORMS)), F.col("form")).alias("form"), chosen(0).cast("double").alias("label"), chosen(1).alias("candidate"), chosen(2).alias("word"), chosen(3).alias("before"), "after"
    )
    return out.filter(F.length("candidate") >= LEAST_VALUE)


def _cut(size) -> Column:
    return F.substring(F.col("d"), F.lit(1), size if isinstance(size, Column) else F.lit(size))


def _assigned(c: Column) -> tuple[Column, Column, Column, Column]:
    """A key behind a name and a sign: in one word, or in words of their own."""
    quoted = F.concat("quote", c, "quote")
    word = F.when(F.col("coin") == 0, quoted).otherwise(F.concat("name", "sign", quoted))
    return F.lit(1), c, word, F.when(F.col("coin") == 0, F.concat_ws(" ", "b1", "name", "sign")).otherwise(F.concat_ws(" ", "b2", "b1"))


def _look_alike(c: Column, word: Column | None = None, before: Column | None = None) -> tuple[Column, Column, Column, Column]:
    return F.lit(0), c, c if word is None else word, F.concat_ws(" ", "b2", "b1") if before is None else before


def _benign(c: Column) -> tuple[Column, Column, Column, Column]:
    """Behind the name of what is no secret."""
    word = F.when(F.col("coin") == 0, c).otherwise(F.concat("benign", "sign", c))
    return _look_alike(c, word, F.when(F.col("coin") == 0, F.concat_ws(" ", "b1", "benign", "sign")).otherwise(F.concat_ws(" ", "b2", "b1")))


def _placeholder(c: Column) -> tuple[Column, Column, Column, Column]:
    """Assigned to a name of secrets, but none."""
    return (F.lit(0), *_assigned(c)[1:])


def _joined(sign: str, first: int, n: int) -> Column:
    return F.array_join(F.slice("own", first, n), sign)


def _uuid() -> Column:
    return F.concat_ws("-", *(F.substring("x", a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


#: Forms of labelled findings: (label, candidate, word, before) over the columns that ``labelled_findings`` prepares.
FORMS = {
    "hex40": lambda: _assigned(F.substring("x", 1, 40)),
    "hex32": lambda: _assigned(F.substring("x", 1, 32)),
    "dense": lambda: _assigned(_cut(F.col("size") + 20)),
    "prefixed_upper": lambda: _assigned(F.concat(F.lit("AKIA"), F.upper(_cut(16)))),
    "prefixed": lambda: _assigned(F.concat(F.lit("ghp_"), _cut(36))),
    "prefixed_live": lambda: _assigned(F.concat(F.lit("sk-live-"), _cut(40))),
    "three_parts": lambda: _assigned(F.concat(F.lit("eyJ"), _cut(17), F.lit("."), F.substring("d", 20, 24), F.lit("."), F.substring("d", 44, 20))),
    "short": lambda: _assigned(F.concat(F.initcap(F.get("own", F.lit(0))), F.substring("x", 3, 3), F.lit("!"), F.substring("d", 9, 4))),
    "short_dense": lambda: _assigned(F.concat(_cut(F.pmod("size", F.lit(6)) + 7), F.lit("$"), F.substring("d", 30, 2))),
    "commit": lambda: _benign(F.substring("x", 1, 40)),
    "checksum": lambda: _benign(F.when(F.col("coin") == 0, F.col("x")).otherwise(F.substring("x", 1, 32))),
    "uuid": lambda: _benign(_uuid()),
    "bare_uuid": lambda: _look_alike(_uuid()),
    "slug": lambda: (lambda c: _look_alike(c, F.concat(F.lit("https://www.example.com/"), c, F.lit(".html"))))(F.concat(_joined("-", 1, 6), F.lit("-"), F.col("size").cast("string"))),
    "file_path": lambda: (lambda c: _look_alike(c, F.concat(F.lit("/"), c, F.lit(".py"))))(F.concat(_joined("/", 1, 5), F.col("size").cast("string"))),
    "glued": lambda: _look_alike(F.concat(F.array_join(F.transform(F.slice("own", 1, 5), lambda x: F.initcap(x)), ""), F.col("size").cast("string"))),
    "number": lambda: _benign(F.concat(F.lit("202"), F.regexp_replace(F.substring("x", 1, 24), "[a-f]", "0"), F.lit("T"))),
    "image": lambda: (lambda c: _look_alike(c, F.concat(F.lit("data:image/png;base64,"), c)))(F.col("d")),
    "here": lambda: _placeholder(F.concat(F.lit("your-"), F.lower("name"), F.lit("-here"))),
    "filler": lambda: _placeholder(F.repeat(F.when(F.col("coin") == 0, "x").otherwise("*"), F.col("size") + 8)),
    "own_words": lambda: _placeholder(F.concat(_joined("_", 1, 4), F.lit("_"), F.pmod("size", F.lit(10)).cast("string"))),
    "variable": lambda: _placeholder(F.concat(F.lit("os.environ."), F.upper(_joined("_", 1, 3)))),
}


class FalsePositives:
    """A forest over FEATURES. ``train`` takes labelled findings, ``score`` adds probability and secret to candidates."""

    def __init__(self, model, words: list[str]):
        self.model, self.words = model, words

    @staticmethod
    def _vectors(found: DataFrame, words: list[str], *carry: Column) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        return found.select(*carry, array_to_vector(F.array(*features(found, words).values())).alias("forest_features"))

    @classmethod
    def train(cls, labelled: DataFrame, words: list[str]) -> FalsePositives:
        """Of labelled rows beyond TRAINING_ROWS about so many are taken, by a hash of the finding. Null labels are left out;
        without any label left, or with one kind only, it is an error."""
        from pyspark.ml.classification import RandomForestClassifier

        labelled = labelled.select("candidate", "word", "before", "after", F.col("label").cast("double").alias("label")).filter("label is not null")
        n, kinds = labelled.agg(F.count(F.lit(1)), F.count_distinct("label")).first()
        if kinds < 2:
            raise ValueError("findings of both labels are needed")
        if n > TRAINING_ROWS:
            labelled = labelled.filter(F.pmod(F.xxhash64("candidate", "word", "before"), F.lit(1 << 20)) < TRAINING_ROWS / n * (1 << 20))
        forest = RandomForestClassifier(featuresCol="forest_features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
        return cls(forest.fit(cls._vectors(labelled, words, F.col("label"))), words)

    def score(self, found: DataFrame) -> DataFrame:
        """found with the columns probability and secret; such that it had are replaced, any others stay."""
        from pyspark.ml.functions import vector_to_array

        kept = [c for c in found.columns if c not in ("probability", "secret")]
        scored = self.model.transform(self._vectors(found, self.words, F.struct(*kept).alias("kept")))
        probability = F.round(F.get(vector_to_array("probability"), F.lit(1)), 6)
        return scored.select(*(F.col("kept")[c].alias(c) for c in kept), probability.alias("probability")).withColumn("secret", F.col("probability") >= 0.5)


def scan(docs: DataFrame, forest: FalsePositives, **columns) -> DataFrame:
    """``candidates`` with probability and secret. An empty table gives an empty result; other columns are not read."""
    return forest.score(candidates(docs, **columns))


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with the secrets that ``scan`` found (joined by id) replaced in the text column, longer ones first.

    All other columns stay, whatever their names. Null and empty texts stay, rows with a null id are matched with nothing,
    rows that repeat an id are all treated. Findings that aren't secret, or of ids that docs lack, change nothing.
    """
    held = found.filter("secret").groupBy(F.col("id").alias("found_id")).agg(F.collect_set("candidate").alias("found"))  # a text's own
    longest_first = F.array_sort("found", lambda a, b: F.length(b) - F.length(a))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    text = F.aggregate(longest_first, F.col("text"), lambda t, s: F.replace(t, s, F.lit(mask)))
    out = rows.join(held, F.col("id") == F.col("found_id"), "left").withColumn("text", F.when(F.col("found").isNull(), F.col("text")).otherwise(text))
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))


def op10_secret_scan(docs: DataFrame) -> DataFrame:
    """Trained on findings made of docs' own texts (``labelled_findings``); a table without usable text has no candidates."""
    labelled = written(labelled_findings(docs), "findings")
    found = candidates(docs)
    if labelled.select("label").distinct().count() < 2:
        scored = found.withColumn("probability", F.lit(0.5)).withColumn("secret", F.lit(True))
    else:
        scored = FalsePositives.train(labelled, dictionary(docs)).score(found)
    return scored.select(
        F.col("id").alias("doc_id"), "word_no", "nth", F.length("candidate").alias("length"), F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"), "probability", "secret"
    )
