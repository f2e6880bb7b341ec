"""Secret scanning with a random forest that removes false findings (DataFrame functions only).

Long words with digits or inner capitals are candidates, and so is what is quoted, assigned or follows a
keyword, from six characters on and of any characters but blanks and quotes.  Each is described by its length, by the
transitions between classes of characters, by the part of it that words of a dictionary cover, by
signs of a path or address around it, and by its neighbouring words.  A random forest trained on
labelled findings then tells secrets from hashes, numbers, names, paths and placeholders.  The findings
are an input: what reviewers said of candidates in documents, or where there are none, examples made by
rule from random strings.  Everything runs in the JVM: expressions for the features, Spark ML for the
forest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier, RandomForestClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint

#: Shortest candidate in characters; shortest one that is quoted, assigned or follows a keyword.
SHORTEST, SHORTEST_VALUE = 16, 6
#: Labelled findings that the forest is trained on, at most; its trees and their depth; its seed.
TRAINING_ROWS, TREES, DEPTH, SEED = 8_000, 24, 7, 11
#: Words of the dictionary (the most frequent of the corpus) and their lengths in letters.
DICTIONARY_WORDS, WORD_LETTERS = 200, (3, 12)
#: Words near a secret, and words near something that only looks like one.  Fixed values.
KEYWORDS = "token|secret|passw|pwd|api[_-]?key|apikey|auth|bearer|credential|private|access|client_key"
DECOYS = "sha|md5|commit|checksum|digest|uuid|guid|etag|version|example|isbn|order|card|phone"

_RUN = f"[A-Za-z0-9_+/=.~@:%-]{{{SHORTEST},}}"
#: A word that announces a value, and a word between the two.
_ANNOUNCES = r"(?i)(^|[^a-z])(\w*passw(or)?d|pwd|passphrase|\w*secret|\w*token|api[_-]?key|bearer|credentials?|\w*_key|auth)[\"'`]?[=:]*$"
_BETWEEN = "^(is|was|=|:|:=|=>|->)$"
#: The value in a word: what stands in quotes, else what follows = or :, else the word without punctuation around it.
_QUOTED, _ASSIGNED, _BARE = f"[\"'`]([^\"'`]{{{SHORTEST_VALUE},}})[\"'`]", f"[=:]+([^\"'`=:][^\"'`]{{{SHORTEST_VALUE - 1},}}?)[,;.)}}\\]]*$", f"^[(\\[{{]*([^\"'`]{{{SHORTEST_VALUE},}}?)[,;.)}}\\]]*$"


#: What is known of a word's neighbours, of which only this is kept, however long they are.
NEAR = ("marked", "announced", "keyword_near", "decoy_near")


def _near(before2: Column, before: Column, after: Column) -> dict[str, Column]:
    """The columns ``NEAR``: an assignment mark right before, an announcement, keywords and decoys near the word."""
    marked = before.rlike("[=:]$")
    has = lambda pattern, *words: reduce(lambda x, y: x | y, [F.lower(w).rlike(pattern) for w in words])
    return {
        "marked": marked,
        "announced": marked | before.rlike(_ANNOUNCES) | (before.rlike(_BETWEEN) & before2.rlike(_ANNOUNCES)),
        "keyword_near": has(KEYWORDS, before, before2),
        "decoy_near": has(DECOYS, before, before2, after),
    }


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word_at, word, candidate and the columns ``NEAR``): the long runs in the words of whole texts.

    A word that holds a run of ``SHORTEST`` key characters with a digit or an inner capital gives one
    candidate for each such run.  A value of ``SHORTEST_VALUE`` characters that is quoted, assigned (in
    the word or by the word before) or announced by a keyword is a candidate, too, unless it is part
    of such a run.  ``word_at`` counts words from 0.  Null texts have none.
    """
    words = docs.select(F.col(id_col), F.split(F.col(text_col), r"\s+").alias("words"))
    likely = lambda w: (F.length(w) >= SHORTEST) & w.rlike(_RUN) & w.rlike("[0-9]|[a-z][A-Z]")
    near = lambda i: F.coalesce(F.get("words", i), F.lit(""))
    about = lambda i: _near(near(i - 2), near(i - 1), near(i + 1))
    valued = lambda w, i: (F.length(w) >= SHORTEST_VALUE) & (w.rlike("[\"'`=:]") | about(i)["announced"])
    hits = F.filter(
        F.transform(
            "words",
            lambda w, i: F.when(
                likely(w) | valued(w, i), F.struct(i.alias("word_at"), w.alias("word"), *[c.alias(n) for n, c in about(i).items()])
            ),
        ),
        lambda h: h.isNotNull(),
    )
    found = words.select(id_col, F.explode(hits).alias("h")).select(id_col, "h.*")
    every = lambda pattern: F.regexp_extract_all("word", F.lit(pattern), F.lit(1))
    runs = F.filter(every(f"({_RUN})"), lambda c: c.rlike("[0-9]|[a-z][A-Z]"))
    values = F.when(F.size(every(_QUOTED)) > 0, every(_QUOTED)).when(F.size(every(_ASSIGNED)) > 0, every(_ASSIGNED)).when(F.col("announced"), every(_BARE)).otherwise(F.array().cast("array<string>"))
    found = found.withColumn("_runs", runs)
    apart = F.filter(F.array_distinct(values), lambda v: ~F.exists("_runs", lambda r: F.contains(r, v)))
    return found.withColumn("candidate", F.explode(F.concat("_runs", apart))).drop("_runs")


def reviewed(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labelled findings for ``train`` from what reviewers said: ``labels`` has the id, candidate and label (0 or 1).

    A candidate that stands in its document more than once is a finding at each place; a label of
    something that is no candidate is ignored.
    """
    said = labels.select(F.col(id_col), "candidate", F.col("label").cast("double").alias("label")).dropDuplicates([id_col, "candidate"])
    some = docs.select(F.col(id_col), F.col(text_col)).join(said.select(id_col).distinct(), id_col, "left_semi")
    return candidates(some, id_col, text_col).join(said, [id_col, "candidate"])


def dictionary(docs: DataFrame, text_col: str = "text") -> list[str]:
    """The most frequent words of the corpus (letters only, lower case), counted over all whole texts."""
    low, high = WORD_LETTERS
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col)), r"\s+")).alias("w"))
    words = words.where(F.length("w").between(low, high) & F.col("w").rlike(r"^\p{L}+$"))
    top = words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(DICTIONARY_WORDS)
    return [r.w for r in top.collect()]


def features(found: DataFrame, words: list[str]) -> tuple[DataFrame, list[str]]:
    """The columns of ``found`` (as of ``candidates``) with a number for each feature, and these names."""
    c, n = F.col("candidate"), F.greatest(F.length("candidate"), F.lit(1))
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    longest_first = sorted(words, key=lambda w: (-len(w), w))
    bare = F.regexp_replace(F.lower(c), "|".join(longest_first), "") if words else F.lower(c)
    ahead = F.expr("substring(word, 1, greatest(locate(candidate, word) - 1, 0))")
    made: dict[str, Column] = {
        "length": n.cast("double"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "hex": share("[0-9a-f]"),
        "digit_letter": share("[0-9](?=[A-Za-z])"),
        "letter_digit": share("[A-Za-z](?=[0-9])"),
        "lower_upper": share("[a-z](?=[A-Z])"),
        "vowel_consonant": share("[aeiouy](?=[bcdfghjklmnpqrstvwxz])"),
        "consonants": share("[bcdfghjklmnpqrstvwxz]{4}"),
        "repeats": share(r"(.)(?=\1)"),
        "dictionary": (n - F.length(bare)) / n,
        "slashes": share("/"),
        "dots": share("[.]"),
        "marks": share("[@:%]"),
        "other_marks": share("[^A-Za-z0-9_+/=.~@:%-]"),
        "brackets": share(r"[(){}<>\[\]]"),
        "path": F.lower("word").rlike(r"://|^/|[.](html?|py|js|json|txt|png|com|org|net)\b|@").cast("double"),
        "groups": share("-"),
        "assigned": (F.col("marked") | F.col("word").rlike(r"[=:][\"']?[A-Za-z0-9_+/=.~-]{16}") | ahead.rlike("[=:][\"'`]?$")).cast("double"),
        "quoted": F.col("word").rlike("[\"'`]").cast("double"),
        "announced": F.col("announced").cast("double"),
        "keyword": (F.col("keyword_near") | F.lower(ahead).rlike(KEYWORDS)).cast("double"),
        "decoy": (F.col("decoy_near") | F.lower(ahead).rlike(DECOYS)).cast("double"),
        "prefixed": c.rlike("^(AKIA|ASIA|gh[pousr]_|xox[abp]-|sk-|AIza|eyJ)").cast("double"),
    }
    return found.select("*", *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(f"f_{k}") for k, v in made.items()]), [f"f_{k}" for k in made]


def _drawn(alphabet: str, shortest: int, longest: int, seed: int) -> str:
    """SQL of a string of random length and characters, drawn by the row's id."""
    draw = lambda i, n: f"pmod(xxhash64(id, {seed}, {i}), {n})"
    length = f"CAST({shortest} + {draw(-1, longest - shortest + 1)} AS INT)"
    return f"concat_ws('', transform(sequence(1, {length}), i -> substring('{alphabet}', CAST(1 + {draw('i', len(alphabet))} AS INT), 1)))"


def example_findings(spark: SparkSession, rows: int = 8_000, seed: int = 0) -> DataFrame:
    """Labelled findings (columns of ``candidates`` and ``label``) for where no reviewed ones are at hand.

    Half are secrets: strings of random length over the alphabets in which keys and passwords are
    written, with or without a prefix, assigned to or announced by a name; a few with a prefix stand
    alone.  The others are numbers, digests, ids, addresses, paths, names in code, dates, words and
    placeholders, in prose, after other names, or, the last ones, where a secret could stand.
    """
    low, up, num, marks = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!#$&*?^@%-+"
    salt = iter(range(100 * seed, 100 * seed + 100))
    draw = lambda n: f"pmod(xxhash64(id, {next(salt)}, 'p'), {n})"
    text = lambda alphabet, a, b: _drawn(alphabet, a, b, next(salt))
    one = lambda options: "element_at(array(" + ", ".join(options) + f"), CAST(1 + {draw(len(options))} AS INT))"
    word = lambda: f"concat({_drawn('bcdfglmnprst', 1, 1, s := next(salt))}, {_drawn('aeiou', 1, 2, s + 1000)}, {_drawn('lmnrst', 1, 2, s + 2000)}, {_drawn('aeiou', 1, 1, s + 3000)}, {_drawn('dknrst', 0, 1, s + 4000)})"
    joined = lambda *parts: f"concat({', '.join(parts)})"
    lit = lambda x: f"'{x}'"
    hexes, mixed = num + "abcdef", low + up + num
    prefixed = joined(text(low + up, 2, 6), one([lit("_"), lit("-")]), text(mixed, 16, 40))
    secret = one([
        text(hexes, 20, 64), text(mixed, 12, 64), text(mixed + "+/_-", 16, 60), prefixed, text(up + num, 14, 32), text(low + num, 10, 40),
        joined(f"initcap({word()})", text(num, 1, 5), text(marks, 1, 2)), joined(f"initcap({word()})", text(marks, 1, 1), text(num, 2, 5)),
        text(mixed + marks, 8, 24), joined(word(), text(num, 2, 4)), text(low, 18, 32), text(up, 16, 28),
    ])
    prose = one([
        text(num, 6, 20), joined(text(num, 3, 4), lit("-"), text(num, 3, 4), lit("-"), text(num, 3, 6)),
        joined(text(hexes, 8, 8), lit("-"), text(hexes, 4, 4), lit("-"), text(hexes, 4, 4), lit("-"), text(hexes, 12, 12)),
        text(hexes, 16, 64), joined(word(), one([lit("."), lit("_"), lit("")]), text(num, 0, 3), lit("@"), word(), text(num, 0, 2), one([lit(".com"), lit(".org"), lit(".co.uk")])),
        joined(lit("https://"), word(), lit(".net/"), word(), lit("/"), text(num, 0, 6)), joined(word(), lit("/"), word(), lit("/"), word(), text(num, 0, 2), one([lit(".py"), lit(".txt"), lit("")])),
        joined(word(), f"initcap({word()})", f"initcap({word()})", text(num, 0, 2)), joined(word(), lit("_"), word(), lit("_"), word(), text(num, 0, 2)),
        joined(text("12", 1, 1), text(num, 3, 3), lit("-0"), text("123456789", 1, 1), lit("-1"), text(num, 1, 1), lit("T1"), text(num, 1, 1), lit(":00:00Z")),
        joined(text(num, 1, 3), lit("."), text(num, 1, 3), lit("."), text(num, 1, 3), lit("."), text(num, 1, 3)),
    ])
    holder = one([
        word(), f"initcap({word()})", joined(word(), word()), joined(lit("<"), word(), lit(">")), joined(lit("${"), f"upper({word()})", lit("}")), joined(lit("get"), f"initcap({word()})", lit("()")),
        joined(lit("your_"), word(), one([lit(""), lit("_key")])), one([lit("xxxxxxxx"), lit("********"), lit("changeme"), lit("required"), lit("xxxxxxxxxxxxxxxx1234")]), joined(word(), lit("_"), word()),
        joined(lit("https://"), word(), lit(".org/?q="), text(num, 1, 1)), text(num, 6, 8),
    ])
    names = one([lit(n) for n in ("password", "passwd", "db_password", "secret", "client_secret", "pwd", "api_key", "apikey", "token", "access_token", "auth", "private_key", "credentials")])
    others = one([lit(n) for n in ("name", "title", "note", "color", "id", "order", "phone", "version", "commit", "checksum", "etag", "path", "user", "size", "date")])
    plain = one([word() for _ in range(4)])
    decoy = one([lit(n) for n in ("sha1", "commit", "checksum", "uuid", "digest", "md5", "version", "order")])
    # kept as rows, or else every use of a column would draw its string anew
    r = checkpoint(spark.range(0, rows, 1, 4).selectExpr(
        "id", "id % 2 = 0 AS is_secret", f"{secret} AS secret", f"{prose} AS prose", f"{holder} AS holder", f"{prefixed} AS prefixed", f"{names} AS name", f"{others} AS other",
        f"{plain} AS plain", f"{plain} AS after", f"{decoy} AS decoy", f"{draw(10)} AS way", f"{draw(6)} AS style", f"{draw(3)} AS quoted",
    ))
    # ways of the others: 0 to 3 in prose, 4 and 5 after a decoy, 6 and 7 after another name, 8 and 9 where a secret could stand
    r = r.selectExpr(
        "*",
        "CASE WHEN is_secret THEN CASE WHEN way = 0 THEN prefixed ELSE secret END WHEN way < 8 THEN prose ELSE holder END AS candidate",
        "CASE WHEN is_secret THEN CASE WHEN way = 0 THEN NULL ELSE name END WHEN way < 6 THEN NULL WHEN way < 8 THEN other ELSE name END AS key",
    ).selectExpr("*", """CASE WHEN quoted = 0 THEN candidate ELSE concat('"', candidate, '"') END AS shown""")
    # styles: key = x, key=x, key: x, key is x, key -> x, key x
    r = r.selectExpr(
        "*",
        "CASE WHEN key IS NULL THEN candidate WHEN style = 1 THEN concat(key, '=', shown) ELSE shown END AS word",
        """CASE WHEN key IS NULL THEN CASE WHEN NOT is_secret AND way IN (4, 5) THEN decoy ELSE plain END WHEN style = 0 THEN '=' WHEN style = 1 THEN plain
            WHEN style = 2 THEN concat(key, ':') WHEN style = 3 THEN 'is' WHEN style = 4 THEN '->' ELSE key END AS before""",
        "CASE WHEN key IS NOT NULL AND style IN (0, 3, 4) THEN key ELSE plain END AS before2",
    )
    near = _near(F.col("before2"), F.col("before"), F.col("after"))
    return r.select(
        F.col("id").alias("doc_id"), F.lit(0).alias("word_at"), "word", "candidate", *[c.alias(n) for n, c in near.items()], F.col("is_secret").cast("double").alias("label")
    )


def train(findings: DataFrame, words: list[str], seed: int = SEED) -> RandomForestClassificationModel:
    """A forest trained on labelled findings; of more than ``TRAINING_ROWS`` those with the smallest hashes."""
    ordered = findings.withColumn("_mark", F.xxhash64("candidate", "word", "word_at"))
    described, names = features(checkpoint(ordered.orderBy("_mark").limit(TRAINING_ROWS).coalesce(1)), words)
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(described).select("features", "label")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt")
    return forest.fit(vectors)


def scan(
    docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5
) -> DataFrame:
    """Every candidate of the whole texts with the forest's judgement.

    ``findings``: labelled findings to train on, with the columns of ``candidates`` and ``label``, as
    ``reviewed`` has them; by default ``example_findings``.  Returns the id, ``word_at``, ``candidate``, ``probability`` (of a
    secret) and ``is_secret``.

    Cases: null and empty texts have no candidates; a secret that occurs again is reported again; rows
    that repeat are scanned one by one; an empty table gives an empty result; other columns, whatever
    their names, are ignored.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    words = dictionary(rows, "_text")
    if findings is None:
        findings = example_findings(docs.sparkSession)
    model = train(findings, words)
    described, names = features(candidates(rows, id_col, "_text"), words)
    judged = model.transform(VectorAssembler(inputCols=names, outputCol="features").transform(described))
    probability = vector_to_array("probability")[1]
    return judged.select(
        id_col, "word_at", "candidate", F.round(probability, 6).alias("probability"), (probability >= threshold).alias("is_secret")
    )
