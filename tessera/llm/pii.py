"""Personal data by candidates and boosted trees, in DataFrame expressions only.

Generators of high recall (one pattern per kind) propose spans, which may overlap. Four base kinds are kept when they
pass their format check. Candidates of the other kinds are scored by gradient-boosted trees over features of their
format and of the text around them; those over the calibrated threshold of their kind are added, unless they overlap a
base span or a better candidate. All of it happens inside the row, so nothing is moved between tasks.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds in the order of the result. Each pattern is scanned once and never backtracks over a run: runs of the first
#: class are entered at their start, or where the last match ended, and repeated groups are possessive.
BASE = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "mail_spelled": r"(?:(?<![A-Za-z0-9._-])|\G)[A-Za-z0-9._-]++ ?(?:[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(] ?(?:dot|DOT) ?[\])]) ?[A-Za-z]{2,20}+)| at [A-Za-z0-9-]++(?: dot [A-Za-z]{2,20}+)++)",
    "phone_local": r"(?<![0-9])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[-. /])[0-9]{3,4}[-. ][0-9]{3,4}(?![0-9])",
    "ssn": r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "account": r"(?<![0-9.])[0-9]{7,20}(?![0-9])",
    "birth_date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}([./-])[0-9]{1,2}\1(?:[0-9]{4}|[0-9]{2}))(?![0-9/-]|\.[0-9])",
    "secret": r"(?<![A-Za-z0-9_+/=.-])[A-Za-z0-9_+/=.-]{16,}+",
    "password": r"(?<=(?:assword|asswd|asswort|pwd|ecret|oken|pi_key|pi-key|pikey|lave)[\"']?[ ]{0,2}[:=][ ]{0,2}[\"']?)[^\s\"',;:=]{6,}+",
}
#: What a text must hold for a kind's pattern to match, as a cheaper test.
NEEDS = {"email": "@", "phone": "+", "mail_spelled": "[(\\[] ?(?:at|AT) ?[\\])]| at [A-Za-z0-9-]++ dot ", "birth_date": "[0-9][./-][0-9]{1,2}[./-][0-9]", "secret": "(?<![A-Za-z0-9_+/=.-])[A-Za-z0-9_+/=.-]{16}", "password": "(?:assw|pwd|ecret|oken|pi.?key|lave)[a-z]*+[\"']? {0,2}[:=]", "phone_local": "[0-9]", "ssn": "-", "iban": "[0-9]", "account": "[0-9]", "ip": "[0-9]", "card": "[0-9]"}
#: Of these strings a text must hold one before that is looked for.
EITHER = {"mail_spelled": (" dot ", "[", "("), "password": ("=", ":")}
AROUND = 40
CUES = {
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|telefon|mobil|t[eé]l[eé]fono|t[eé]l[eé]phone|llame|appelez)\b",
    "mail": r"(?i)\b(?:mail|e-mail|email|contact|write|kontakt|correo|courriel)\b",
    "tax": r"(?i)\b(?:ssn|social security|tax id|sozialversicherung|seguridad social|s[eé]curit[eé] sociale)\b",
    "bank": r"(?i)\b(?:iban|bank|account|acct|konto|cuenta|compte|passport|licen[cs]e no|patient|member id|customer|client|kunden(?:nummer|nr)?|cliente)\b",
    "birth": r"(?i)\b(?:born|birth|birthday|dob|geboren|geburtsdatum|n[eé]e?|naissance|nacid[oa]|nacimiento)\b",
    "secret": r"(?i)(?:token|secret|passw|pwd|api[ _-]?key|credential|bearer|authorization|private[ _-]?key|access[ _-]?key|clave|schl[uü]ssel|mot de passe)",
    "other": r"(?i)\b(?:order|invoice|version|isbn|ref|page|part|tracking|sku|ticket|build|id|score|total|copyright|serial|figure|lot)\b",
}
TREES, RATE, MIN_PRECISION = 24, 0.3, 0.98
FEATURES = ("kind", "digits", "length", "marks", "phone", "mail", "tax", "bank", "birth", "secret", "other", "behind", "joined", "valid", "assigned", "mixed", "prefix")
#: How known kinds of keys begin (fixed value).
PREFIX = r"^(?:AKIA|ASIA|gh[opsu]_|github_pat_|glpat-|sk-|xox[abps]-|eyJ[A-Za-z0-9]|AIza|SG\.)"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def worth(i: Column) -> Column:
        x = F.substring(d, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def mod97(m: Column) -> Column:
    """The check value of an account number by ISO 13616: 1 if it is right."""
    s = F.regexp_replace(m, " ", "")
    s = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))
    at = lambda i: F.substring(s, i, F.lit(1))
    step = lambda a, i: F.when(at(i) < "A", (a * 10 + F.ascii(at(i)) - 48) % 97).otherwise((a * 100 + F.ascii(at(i)) - 55) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), step)


def passes(kind: str, m: Column) -> Column:
    """Whether a match of a base kind passes the check of its format."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    d = _digits(m)
    if kind == "card":
        return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)
    return F.length(d).between(9, 15)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once although body may use it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Prefix sums add up whole blocks of this size, so that arrays of many matches take no quadratic time.
BLOCK = 64


def before(lengths: Column) -> Column:
    """The sum of what comes before each of an array of ints."""
    add = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)

    def sums(n: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / BLOCK).cast("int")), lambda b: add(F.slice(n, b * BLOCK + 1, F.lit(BLOCK))))
        heads = F.aggregate(blocks, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
        return let(heads, lambda h: F.transform(n, lambda _, i: h[F.floor(i / BLOCK).cast("int")] + add(F.slice(n, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))))

    return F.when(F.size(lengths) > 0, let(lengths, sums)).otherwise(F.array().cast("array<int>"))


def _features(c: Column) -> Column:
    """The features of a candidate (struct of kind, m, before, after), as a struct of ints."""
    m, around = c["m"], F.concat(c["before"], F.lit(" \x01 "), c["after"])
    kinds = list(PATTERNS)
    area = F.substring(m, 1, 3)
    valid = (
        F.when(c["kind"] == kinds.index("iban"), mod97(m) == 1)
        .when(c["kind"] == kinds.index("ssn"), ~area.isin("000", "666") & (area < "900") & (F.substring(m, 5, 2) != "00"))
        .when(c["kind"] == kinds.index("phone_local"), F.length(_digits(m)).between(9, 11))
        .when(c["kind"] == kinds.index("birth_date"), m.rlike(r"^(?:(?:19|20)[0-9]{2}-(?:0?[1-9]|1[0-2])-(?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[./-](?:0?[1-9]|[12][0-9]|3[01])[./-](?:(?:19|20)[0-9]{2}|[0-9]{2}))$"))
        .when(c["kind"] == kinds.index("password"), m.rlike("[0-9]") & m.rlike("[A-Za-z]"))
        .when(c["kind"] == kinds.index("mail_spelled"), m.rlike(r"(?i)(?:dot[\])]? ?[a-z]+|\.(?:com|org|net|edu|info|de|fr|es|it|uk|io))$"))
        .when(c["kind"] == kinds.index("secret"), m.rlike(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$"))
        .otherwise(False)
    )
    flags = [F.when(c["before"].rlike(CUES[k]), 1).otherwise(0).alias(k) for k in ("phone", "mail", "tax", "bank", "birth", "secret")]
    flags += [F.when(around.rlike(CUES["other"]), 1).otherwise(0).alias("other"), F.when(reduce(lambda a, k: a | c["after"].rlike(CUES[k]), ("tax", "bank", "birth", "secret"), c["after"].rlike(CUES["phone"])), 1).otherwise(0).alias("behind")]
    joined = F.when(c["before"].rlike(r"[A-Za-z0-9#$/=.-]$") | c["after"].rlike(r"^(?:[A-Za-z0-9/=-]|\.[0-9])"), 1).otherwise(0)
    return F.struct(
        c["kind"].cast("int").alias("kind"), F.length(_digits(m)).alias("digits"), F.length(m).alias("length"),
        F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")).alias("marks"), *flags, joined.alias("joined"), F.when(valid, 1).otherwise(0).alias("valid"),
        F.when(c["before"].rlike(r"[:=] {0,2}[\"']?$"), 1).otherwise(0).alias("assigned"), F.when(m.rlike("[0-9]") & m.rlike("[A-Za-z]") & ~m.rlike(r"[./].*[./]|^[a-z]+[0-9]{1,4}$"), 1).otherwise(0).alias("mixed"), F.when(m.rlike(PREFIX), 1).otherwise(0).alias("prefix"),
    )


#: What stands before a candidate that is one, and before one that is not: a half for the fit, the rest for calibration.
CONTEXTS = {
    "phone_local": ["phone: ", "call me at ", "Tel. ", "mobile ", "fax ", "reach us by telephone on ", "my cell is ", "Telefon ", "Mobil: ", "tel: "],
    "ssn": ["SSN ", "social security number ", "ssn: ", "her tax id is ", "Social Security: ", "tax id no. ", "my tax id "],
    "iban": ["IBAN ", "bank account ", "pay to ", "Konto ", "transfer it to ", "cuenta "],
    "mail_spelled": ["mail ", "contact ", "", "write to ", "reach me at ", "send it to "],
    "account": ["account ", "bank account no. ", "passport ", "acct: ", "patient ", "customer no ", "client number ", "Kundennummer ", "member id "],
    "birth_date": ["born ", "born on ", "date of birth: ", "DOB ", "geboren am ", "née le ", "her birthday is ", "nacido el "],
    "secret": ["token = \"", "api_key: ", "secret=", "password: ", "Authorization: Bearer ", "access key ", "API key '", "credentials: ", "clave: "],
    "password": ["password: ", "pwd=", "secret=\"", "token = ", "Passwort: ", "api_key='"],
}
OFF = ["order ", "invoice ", "version ", "ISBN ", "ref ", "page ", "tracking ", "sku ", "build ", "total ", "the population reached ", "of ", "", "and then ", "on ", "updated ", "commit ", "see ", "file ", "checksum ", "published ", "a sum of ", "line ", "until ", "at "]


def _examples(seed: int = 11, part: int = 0) -> list[dict]:
    """Labelled candidates of the kinds that are not base, made up by a fixed seed; part 0 and 1 take other contexts."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    letters = lambda n, of="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789": "".join(rng.choice(of) for _ in range(n))
    word = lambda: letters(rng.randint(3, 9), "abcdefghijklmnopqrstuvwxyz")

    def iban(right: bool) -> str:
        body, land = digits(18), rng.choice(["DE", "FR", "ES", "GB"])
        number = int(body + "".join(str(ord(x) - 55) for x in land) + "00")
        return f"{land}{(98 - number % 97 + (0 if right else rng.randint(1, 50))) % 97 + (0 if right else 1):02d}{body}"

    def secret(ok: bool) -> str:
        if ok:
            return rng.choice([letters(40, "0123456789abcdef"), "AKIA" + letters(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), "ghp_" + letters(36), "sk-" + letters(32), "eyJ" + letters(30) + "." + letters(40), letters(rng.randint(18, 40)), letters(32, "0123456789abcdef")])
        return rng.choice([f"{word()}-{word()}-{word()}", f"example.org/{word()}/{word()}", word() + word() + word(), f"{word()}_{word()}_{word()}.py", "=" * 20, "." * 18, "-" * 24, f"{word()}/{word()}/{word()}{digits(2)}", letters(40, "0123456789abcdef")])

    date = lambda: rng.choice([f"{rng.randint(1930, 2015)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1930, 2015)}", f"{rng.randint(1, 12):02d}/{rng.randint(1, 28):02d}/{rng.randint(1930, 2015)}"])
    phone = lambda: rng.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"0{digits(2)} {digits(4)} {digits(4)}"])
    spelled = lambda ok: (rng.choice([f"{word()} [at] {word()} [dot] com", f"{word()}.{word()} (at) {word()} (dot) org", f"{word()} at {word()} dot com"]) if ok else rng.choice(["x[at]y.size", f"f(at){word()}.length", f"a (at) {word()}.value", f"{word()}[at]{word()}.index"]))
    make = {"phone_local": lambda _: phone(), "ssn": lambda ok: f"{rng.randint(1, 665) if ok else rng.choice([0, 666, 950]):03d}-{rng.randint(1, 99):02d}-{digits(4)}", "iban": iban, "mail_spelled": spelled, "account": lambda _: digits(rng.randint(7, 20)), "birth_date": lambda _: date(), "secret": secret, "password": lambda ok: rng.choice([word() + digits(2) + "!", word() + digits(2), letters(10)]) if ok else rng.choice([word() + word(), "required", word() + "ing", "(optional)"])}
    kinds, out = list(PATTERNS), []
    for kind, f in make.items():
        for k in range(200):
            good = k % 2 == 0
            right = good or kind not in ("ssn", "iban", "mail_spelled", "secret", "password") or kind == "iban" and rng.random() < 0.1
            before = rng.choice(CONTEXTS[kind][part::2] if good else OFF[part::2])
            m = f(right)
            if kind == "password" and not good:
                before = rng.choice(CONTEXTS[kind][part::2])
            if kind == "secret" and good and m[:3] in ("AKI", "ghp", "sk-", "eyJ") and rng.random() < 0.5:
                before = rng.choice(["the key is ", "my ", "use ", "", "it was "])
            if kind == "secret" and not good and "/" in m and rng.random() < 0.5:
                before, m = before + rng.choice(["https:", "http:"]), "//" + m
            if kind == "iban" and right and not good:
                m = iban(False)
            if kind == "secret" and not good and len(m) == 40 and rng.random() < 0.5:
                before = rng.choice(["commit ", "checksum "])
            joined = rng.random() < (0.02 if good else 0.3)
            around = " ".join(word() for _ in range(3))
            out.append({"kind": kinds.index(kind), "m": m, "before": f"{around} {before}" + ("#" if joined else ""), "after": rng.choice([" and more", ".", ", thanks", "", '" ' + word(), " " + word(), *([f" {word()} and {x}" for x in ("bank account totals", "the phone", "passwords")] if not good or rng.random() < 0.3 else [])]), "label": int(good)})
    rng.shuffle(out)
    return out


def _tree(rows: list[tuple], grad: list[float], hess: list[float], own: list[int], depth: int) -> tuple | float:
    """A regression tree: (feature, cut, left if at most cut, right) or a leaf's value."""
    g, h = sum(grad[k] for k in own), sum(hess[k] for k in own)
    best: tuple = (1e-6, None)
    if depth:
        for f in range(len(FEATURES)):
            sums: dict[int, list[float]] = {}
            for k in own:
                s = sums.setdefault(rows[k][f], [0.0, 0.0])
                s[0] += grad[k]
                s[1] += hess[k]
            a = b = 0.0
            for v in sorted(sums)[:-1]:
                a, b = a + sums[v][0], b + sums[v][1]
                gain = a * a / (b + 1) + (g - a) ** 2 / (h - b + 1) - g * g / (h + 1)
                if gain > best[0]:
                    best = (gain, (f, v))
    if best[1] is None:
        return round(RATE * g / (h + 1), 6)
    f, v = best[1]
    return (f, v, _tree(rows, grad, hess, [k for k in own if rows[k][f] <= v], depth - 1), _tree(rows, grad, hess, [k for k in own if rows[k][f] > v], depth - 1))


def _value(tree: tuple | float, row: tuple) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def scored_examples(spark: SparkSession, examples: list[dict]) -> list[tuple[tuple, int]]:
    """(features, label) of examples, by the same expressions as in use."""
    made = F.from_json(F.lit(json.dumps(examples)), "array<struct<kind:int,m:string,before:string,after:string,label:int>>")
    table = spark.range(1).select(F.posexplode(made).alias("k", "c")).select("k", "c.label", _features(F.col("c")).alias("f"))
    return [(tuple(r["f"]), r["label"]) for r in sorted(table.collect(), key=lambda r: r["k"])]  # the examples, a fixed number


_MODELS: dict[str, tuple[list, dict[int, float]]] = {}


def model(spark: SparkSession) -> tuple[list, dict[int, float]]:
    """The trees, and the threshold of each kind: about the least margin from which other examples, in contexts that the trees
    were not fitted on, have at least the wanted precision, and not below even odds. Features come from the same expressions as in use."""
    if (key := spark.sparkContext.applicationId) not in _MODELS:
        fit, held = (scored_examples(spark, _examples(11 + part, part)) for part in (0, 1))
        rows, y = [r for r, _ in fit], [t for _, t in fit]
        margin, trees = [0.0] * len(rows), []
        for _ in range(TREES):
            p = [1 / (1 + math.exp(-x)) for x in margin]
            trees.append(_tree(rows, [t - q for t, q in zip(y, p, strict=True)], [q * (1 - q) for q in p], list(range(len(rows))), 4))
            margin = [x + _value(trees[-1], r) for x, r in zip(margin, rows, strict=True)]
        least = {}
        for kind in {r[0] for r, _ in held}:
            own = sorted(((sum(_value(t, r) for t in trees), y) for r, y in held if r[0] == kind), reverse=True)
            right, least[kind] = 0, 1e9
            for n, (x, t) in enumerate(own, 1):
                right += t
                if right / n >= MIN_PRECISION and (n == len(own) or own[n][0] < x):  # half way to the next, and likelier than not
                    least[kind] = max(0.0, (x + own[min(n, len(own) - 1)][0]) / 2)
        _MODELS[key] = trees, least
    return _MODELS[key]


def _margin(trees: list, f: Column) -> Column:
    def case(t: tuple | float) -> Column:
        if not isinstance(t, tuple):
            return F.lit(float(t))
        return F.when(f[FEATURES[t[0]]] <= t[1], case(t[2])).otherwise(case(t[3]))

    return reduce(lambda a, b: a + b, map(case, trees))


def _candidates(text: Column, number: int, kind: str) -> tuple[Column, Column]:
    """All matches of a kind, and the stretches of text between them."""
    need = NEEDS[kind]
    may = F.contains(text, F.lit(need)) if len(need) == 1 else text.rlike(need)
    if kind in EITHER:
        may = reduce(lambda a, x: a | F.contains(text, F.lit(x)), EITHER[kind][1:], F.contains(text, F.lit(EITHER[kind][0]))) & may
    found = F.when(may, F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return found, F.lit(PATTERNS[kind])


def fresh(docs: DataFrame, column: str, *wanted: str) -> list[str]:
    """Column names that docs does not have."""
    mark = column
    while any(c.lower().startswith(f"{mark}_".lower()) for c in docs.columns):
        mark += "_"
    return [f"{mark}_{x}" for x in wanted]


def with_spans(docs: DataFrame, column: str, text: str = "text") -> DataFrame:
    """docs with the array `column` of struct(start, end, kind, base), by start, then kind in the order of PATTERNS.

    Offsets are code points, end exclusive; null texts count as empty. Base spans that pass their check are all kept, also
    where kinds overlap; added spans overlap nothing. Texts of any length are scanned whole, in one pass a kind. Repeated rows
    have the same spans each; an empty table gives no rows. A column of that name is replaced, all others stay.
    """
    names = fresh(docs, column, "found", "cands", "spans")
    found, cands, raw = names
    trees, least = model(docs.sparkSession)
    kinds = list(PATTERNS)
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn(found, F.struct(*[_candidates(t, k, kind)[0].alias(kind) for k, kind in enumerate(kinds)]))

    def placed(number: int, kind: str) -> Column:
        m = F.col(found)[kind]
        parts = F.split(t, PATTERNS[kind], -1)
        one = F.transform(
            F.arrays_zip(m.alias("m"), F.slice(parts, F.lit(1), F.size(m)).alias("a"), F.slice(parts, F.lit(2), F.size(m)).alias("b")),
            lambda z: F.struct(F.lit(number).alias("kind"), z["m"].alias("m"), F.length(z["a"]).alias("gap"), F.right(z["a"], F.lit(AROUND)).alias("before"), F.left(z["b"], F.lit(AROUND)).alias("after")),
        )
        starts = lambda z: F.zip_with(z, before(F.transform(z, lambda c: c["gap"] + F.length(c["m"]))), lambda c, at: F.struct(c["kind"].alias("kind"), c["m"].alias("m"), c["before"].alias("before"), c["after"].alias("after"), (at + c["gap"]).alias("start")))
        none = F.array().cast("array<struct<kind:int,m:string,before:string,after:string,start:int>>")
        return F.when(F.size(m) > 0, let(one, starts)).otherwise(none)

    df = df.withColumn(cands, F.concat(*[placed(k, kind) for k, kind in enumerate(kinds)]))

    def judged(c: Column) -> Column:
        base = c["kind"] < len(BASE)
        ok = reduce(lambda a, k: a.when(c["kind"] == k, passes(BASE[k], c["m"])), range(len(BASE)), F.when(F.lit(False), False))
        cut = F.create_map(*[F.lit(x) for kind, v in sorted(least.items()) for x in (kind, float(v))])
        score = _margin(trees, c["features"]) - F.try_element_at(cut, c["kind"])
        return F.struct(c["start"].alias("start"), c["kind"].alias("ord"), (c["start"] + F.length(c["m"])).alias("end"), (base & ok).alias("base"), F.when(base, F.when(ok, 1.0).otherwise(-1.0)).otherwise(score).alias("score"))

    seen = F.transform(F.col(cands), lambda c: F.struct(c["kind"].alias("kind"), c["m"].alias("m"), c["start"].alias("start"), F.when(c["kind"] >= len(BASE), _features(c)).alias("features")))
    df = df.withColumn(raw, F.array_sort(F.filter(F.transform(seen, judged), lambda s: s["score"] >= 0)))
    def settled(z: Column) -> Column:
        sooner = lambda o, s: (o["start"] < s["start"]) | (o["start"] == s["start"]) & (o["ord"] < s["ord"])
        beats = lambda o, s: (o["start"] < s["end"]) & (s["start"] < o["end"]) & (o["base"] | (o["score"] > s["score"]) | (o["score"] == s["score"]) & sooner(o, s))
        kept = F.filter(z, lambda s: s["base"] | ~F.exists(z, lambda o: beats(o, s)))
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(F.array(*map(F.lit, kinds)), s["ord"] + 1).alias("kind"), s["base"].alias("base")))

    shown = let(F.col(raw), settled)
    return df.withColumn(column, F.when(F.size(raw) > 0, shown).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string,base:boolean>>"))).drop(*names)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of text replaced by its kind in brackets; overlapping spans become one of the first's kind.

    A null text stays null, an empty one empty; repeated rows are treated each, an empty table gives no rows. Columns other than
    text (and n_chars, the code points of text, where there is one) stay.
    """
    own = fresh(docs, "redacted", "spans")[0]
    df = with_spans(docs, own, text)
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        new = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when((F.size(acc) > 0) & (s["start"] < last["end"]), F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), wider)).otherwise(F.array_append(acc, new))

    t, spans = F.col(text), F.col(own)
    apart = let(spans, lambda z: F.forall(F.sequence(F.lit(1), F.size(z)), lambda i: (i == 1) | (z[i - 1]["start"] >= z[F.greatest(i - 2, F.lit(0))]["end"])))
    plain = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    df = df.withColumn(own, F.when(F.size(spans) == 0, none).when(apart, plain).otherwise(F.aggregate(spans, none, step)))

    def pieces(z: Column) -> Column:
        until = lambda i: F.when(i > 0, z[F.greatest(i - 1, F.lit(0))]["end"]).otherwise(0)
        return F.transform(z, lambda s, i: F.concat(F.substring(t, until(i) + 1, s["start"] - until(i)), F.lit("["), F.upper(s["kind"]), F.lit("]")))

    parts = let(spans, pieces)
    rest = F.substring(t, F.element_at(spans, -1)["end"] + 1, F.length(t))
    df = df.withColumn(text, F.when(F.size(spans) > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(t))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])
