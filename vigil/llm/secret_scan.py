"""Secret scans: candidates judged by a random forest. DataFrame functions only on the main path.

Candidates are all long runs of key characters in a word that hold a digit or change case often. A random forest on their length, character transitions, dictionary
coverage, path signs and neighbouring words sorts out false positives. It is trained from labelled findings (their features
are worked out by the same expressions) in numpy and becomes one SQL expression.
"""

from __future__ import annotations

import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .url_filter import LOWER, UPPER

#: A run of key characters, at the start of a word or behind a sign that ends a name or opens a quotation.
RUN = r"""(?:^|[=:"'(<>,;\[{`])([A-Za-z0-9_/+.\-]{16,}={0,2})"""
DICTIONARY = "tion|ment|ing|the|and|for|ent|ion|con|com|ver|ter|est|all|her|his|men|able|ous|ung|ein|sch|que|les|des|ado|http|www|file|user|home|data|index|html|version|release|test|src|lib|er|en|in|an|re|on|th"
SECRET_WORDS = "token|secret|passw|pwd|api.?key|access.?key|auth|credential|bearer|private|key"
OTHER_WORDS = "commit|sha1|sha256|md5|checksum|digest|revision|uuid|guid|isbn|iban|phone|order|ref|page|path|file|image|see"
FEATURES = ("length", "digits", "uppers", "transitions", "dictionary", "slashes", "dots", "hex", "prefix", "secret_word", "other_word", "assigned")
TREES, DEPTH = 15, 6


def candidates(text: Column) -> Column:
    """Array of (at, word, match, before, after): the word's place in the text, a run in it, up to two words before it and one behind it."""
    w = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    long = F.filter(F.transform(w, lambda x, i: F.struct(i.alias("at"), x.alias("word"))), lambda c: (F.length(c["word"]) >= 16) & c["word"].rlike(RUN))
    runs = lambda c: F.filter(F.regexp_extract_all(c["word"], F.lit(RUN), F.lit(1)), lambda m: m.rlike("[0-9]") | (F.regexp_count(m, F.lit("[a-z][A-Z]")) >= 3))
    row = lambda c, m: F.struct(
        c["at"].alias("at"), c["word"].alias("word"), m.alias("match"), F.concat_ws(" ", F.get(w, c["at"] - 2), F.get(w, c["at"] - 1)).alias("before"), F.coalesce(F.get(w, c["at"] + 1), F.lit("")).alias("after")
    )
    return F.flatten(F.transform(long, lambda c: F.transform(runs(c), lambda m: row(c, m))))


def features(match: str = "match", word: str = "word", before: str = "before", after: str = "after") -> dict[str, Column]:
    """Features of a candidate by DataFrame functions; the words around it and its own word's prefix count as neighbours."""
    m, n = F.col(match), F.length(match)
    around = F.translate(F.concat_ws(" ", before, F.substring(word, F.lit(1), F.greatest(F.lit(0), F.instr(word, m) - 1)), after), UPPER, LOWER)
    part = lambda rx: (n - F.length(F.regexp_replace(m, rx, ""))) / n
    low = F.translate(m, UPPER, LOWER)
    return {
        "length": n.cast("double"), "digits": part("[0-9]"), "uppers": part("[A-Z]"), "transitions": F.regexp_count(m, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")) / n,
        "dictionary": (n - F.length(F.regexp_replace(low, DICTIONARY, ""))) / n, "slashes": part("/").cast("double"), "dots": part("[.]"),
        "hex": m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double"), "prefix": m.rlike("^(?:AKIA|ASIA|ghp_|gho_|sk-|xox[bp]-|AIza|glpat-|eyJ)").cast("double"),
        "secret_word": around.rlike(SECRET_WORDS).cast("double"), "other_word": around.rlike(OTHER_WORDS).cast("double"), "assigned": F.concat_ws(" ", before, F.substring(word, F.lit(1), F.greatest(F.lit(0), F.instr(word, m) - 1))).rlike(r"[=:]\s*[\"']?$").cast("double"),
    }


def labelled_findings(n: int = 1500, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """Findings (word, match, before, after, label) as reviewers would mark them: keys of common shapes, and look-alikes."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    b64, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    names = ["token", "secret", "api_key", "password", "access_key", "auth_token", "private_key", "passwd", "client_secret", "API_KEY", "TOKEN", "credential"]
    syl = ["tion", "ing", "er", "th", "en", "sch", "ment", "que", "re", "lich", "ado", "ou", "an"]
    out = []
    while len(out) < n:
        shape = r.randrange(6)
        m = [pick(hexa, r.choice([32, 40, 64])), pick(hexa, 40).upper(), pick(b64, r.choice([24, 32, 40, 48])) + "7", "AKIA" + pick(string.ascii_uppercase + string.digits, 15) + "4", "ghp_" + pick(b64, 35) + "1", "sk-" + pick(b64, 47) + "9"][shape]
        name, form = r.choice(names), r.randrange(4)
        tail = r.choice(["", "", '"', '"!!', '"###', ";", '",'])
        if form == 0:
            out.append((f'"{m}{tail}', m, f"{name} =", "", 1))
        elif form == 1:
            out.append((f"{name}={m}", m, r.choice(["set", "export", ""]), "", 1))
        elif form == 2:
            out.append((m, m, f"the {name}:", "", 1))
        elif shape >= 3:
            out.append((m, m, r.choice(["use", "with", "is"]), "", 1))
        w = lambda: "".join(r.choice(syl) for _ in range(r.randint(3, 7)))
        kind = r.randrange(10)
        m = [
            pick(hexa, 40), f"{pick(hexa, 8)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 12)}", f"/{w()}/{w()}/{r.randint(1, 999)}.html", f"{w()}{w()}{r.randint(0, 99)}", f"20{r.randint(10, 30)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}T0{r.randint(0, 9)}.{r.randint(10, 59)}.00Z",
            f"{w()}-{w()}-{r.randint(1, 99)}", f"v{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 99)}-{w()}.{r.randint(0, 9)}", pick(string.digits, r.randint(16, 22)), f"www.{w()}.example.com/{r.randint(1, 999)}", pick(hexa, 64),
        ][kind]
        if len(m) >= 16:
            before = {0: "commit", 9: "sha256 checksum", 1: "uuid", 7: "order"}.get(kind, r.choice(["see", "the", "of", "in", "a", "from", "and", "key to", "file", "="]))
            out.append((r.choice([m, f"({m}", f'"{m}"']), m, before, r.choice(["", "and", "the"]), 0))
    return out


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int):
    """A tree by Gini impurity over a random third of the features: (feature, threshold, left, right) or a share."""
    p = y.mean()
    if not depth or p in (0, 1) or len(y) < 4:
        return float(p)
    best = None
    for f in rng.choice(x.shape[1], max(2, x.shape[1] // 3), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(cut):
            continue
        a, b = t[cut - 1] / cut, (t[-1] - t[cut - 1]) / (len(y) - cut)
        g = cut * a * (1 - a) + (len(y) - cut) * b * (1 - b)
        k = int(np.argmin(g))
        if best is None or g[k] < best[0]:
            best = (g[k], int(f), float((v[cut[k] - 1] + v[cut[k]]) / 2))
    if best is None:
        return float(p)
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[left], y[left], rng, depth - 1), grow(x[~left], y[~left], rng, depth - 1)


def as_sql(tree) -> str:
    if isinstance(tree, float):
        return f"{tree:.6f}D"
    f, t, a, b = tree
    return f"if(f.{FEATURES[f]} <= {t!r}D, {as_sql(a)}, {as_sql(b)})"


def train(spark: SparkSession, findings: list[tuple[str, str, str, str, int]], seed: int = 2) -> list:
    """Trees from labelled findings (a list in the driver, so bounded)."""
    df = spark.createDataFrame(findings, "word string, match string, before string, after string, label int")
    rows = df.select(*[c.alias(k) for k, c in features().items()], "label").collect()
    x, y = np.array([r[:-1] for r in rows], dtype=float), np.array([r[-1] for r in rows], dtype=float)
    rng = np.random.default_rng(seed)
    trees = []
    for _ in range(TREES):
        i = rng.integers(0, len(y), len(y))
        trees.append(grow(x[i], y[i], rng, DEPTH))
    return trees


def scan(docs: DataFrame, trees: list, threshold: float = 0.5) -> DataFrame:
    """One row per candidate: doc_id, at (word, from 0), match, score, is_secret.

    Null and empty texts have none; rows that repeat repeat; a null doc_id stays null; other columns are not used; an empty
    table gives an empty result.
    """
    found = docs.select("doc_id", F.explode(candidates(F.coalesce(F.col("text"), F.lit("")))).alias("c")).select("doc_id", "c.*")
    found = found.withColumn("f", F.struct(*[c.alias(k) for k, c in features().items()]))
    score = F.expr("(" + " + ".join(as_sql(t) for t in trees) + f") / {len(trees)}D")
    return found.select("doc_id", F.col("at").cast("bigint").alias("at"), "match", F.round(score, 6).alias("score")).withColumn("is_secret", F.col("score") >= threshold)
