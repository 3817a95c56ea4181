"""Personal data by candidate gradient boosting.

Generators of high recall propose spans, which may overlap: the four base patterns, and looser ones (obfuscated and named e-mail
addresses, addresses of version 6 or with ports, numbers of a card's length with any separators, national phone numbers and those with
extensions, and secrets: long mixed runs and what is assigned to a name). Boosted trees score each candidate by its format and by the
words around it, and a threshold for each kind, calibrated on held-out rows, selects. Base spans that pass their checks always stay.

The trees are trained on a synthetic sample of labelled candidates of a fixed size (``TRAINING_ROWS``); the corpus has no part in it.
Among its negatives are the formats of the positives in other company: dates, times, order numbers, hashes of commits, paths, and the
tails of longer numbers. The trees' splits become one SQL expression, so texts are scanned, scored and redacted by DataFrame functions
in the JVM, without a shuffle. A candidate is judged by itself, so the work is linear in a text's length and number of spans.

Defined cases: a null text counts as empty and has no spans; a null doc_id stays null; repeated rows are rows each; an empty table
gives an empty result; extra columns are ignored by ``find`` and kept by ``redact``. Spans that overlap are all listed; ``redact``
replaces what they cover together once, by the kind of the first.
"""

from __future__ import annotations

import random
import re
from typing import NamedTuple

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import text_of

KINDS = ("email", "ip", "card", "phone", "secret")
TRAINING_ROWS = 6000
PRECISION = 0.98
AROUND = 24
#: Code points of a block of a text that is redacted.
BLOCK = 1024

# A match of a base pattern begins where a run of its first class begins, or right after the match before it (\G): a later start in
# the same run could only fail as well. Possessive runs keep long texts linear.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?:\x20?[\[({<]\x20?at\x20?[\])}>]\x20?|\x20at\x20)", r"(?:\x20?[\[({<]\x20?dot\x20?[\])}>]\x20?|\x20dot\x20|\.)"


class Generator(NamedTuple):
    kind: str
    pattern: str
    needs: str  # a text without this has no match


GENERATORS = (
    Generator("email", BASE["email"], r"@"),
    Generator("ip", BASE["ip"], r"[0-9]\.[0-9]"),
    Generator("card", BASE["card"], r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"),
    Generator("phone", BASE["phone"], r"\+[0-9]"),
    # the looser ones; each run is bounded
    Generator("email", rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{{1,64}}+{_AT}[a-z0-9-]{{1,63}}+(?:{_DOT}[a-z0-9-]{{1,63}}+){{1,4}}", r"(?i)[\[({<\x20]at[\])}>\x20]"),
    Generator("email", r"(?<![\p{L}.'-])\p{L}[\p{L}.'-]{0,30}+(?:\x20\p{L}[\p{L}.'-]{0,30}+){0,3}\x20<[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,6}>", r"<[A-Za-z0-9._%+-]{1,64}@"),
    Generator("ip", r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{3,39}(?![0-9A-Za-z:])", r":[0-9A-Fa-f]{0,4}:"),
    Generator("ip", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{2,5}|/[0-9]{1,2})(?![0-9.])", r"\.[0-9]{1,3}[:/][0-9]"),
    Generator("card", r"(?<![0-9])[0-9](?:[\x20._/-]?[0-9]){12,18}(?![0-9])", r"[0-9]{4}[\x20._/-]?[0-9]{4}"),
    Generator("phone", r"(?<![0-9+.])(?:00[1-9][0-9]{0,2}[\x20.-]?)?(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20./-])[0-9]{2,5}(?:[\x20./-][0-9]{2,5}){0,3}(?![0-9])", r"[0-9][\x20./)-]\x20?[0-9]{2}"),
    Generator("phone", r"\+[0-9][\x20().0-9-]{6,20}[0-9]\x20?(?i:x|ext\.?|extension)\x20?[0-9]{1,6}(?![0-9])", r"\+[0-9]"),
    Generator("secret", r"(?<![A-Za-z0-9+/_.~-])(?=[A-Za-z+/_.~-]{0,60}[0-9])[A-Za-z0-9+/_.~-]{16,256}+={0,2}", r"[A-Za-z0-9+/_.~-]{16}"),
    Generator("secret", r"(?<=[=:]\x20?[\x22\x27]?)[^\s\x22\x27=:,;]{6,64}", r"[=:]\x20?[\x22\x27]?[^\s\x22\x27=:,;]{6}"),
)
#: The first generators are the base patterns.
BASES = len(BASE)
#: Words before a span that speak for its kind, and words that speak for something else.
CUES = {
    "email": r"(?i)mail|contact|write|reach|address",
    "ip": r"(?i)\bip\b|host|server|addr|from|login|client|connect",
    "card": r"(?i)card|visa|credit|debit|pay|amex",
    "phone": r"(?i)phone|tel|call|mobile|cell|fax|dial|contact|sms",
    "secret": r"(?i)(?:token|secret|passw|pwd|api.?key|access.?key|auth|credential|private.?key|bearer)[A-Za-z0-9_-]{0,12}[^A-Za-z0-9]{0,6}$",
}
OTHER = r"(?i)version|\bv$|order|invoice|\bid\b|sku|isbn|release|serial|build|\bref|ticket|\bsection|chapter|tracking|\bno\b|commit|\bsha|md5|checksum|http|www|\bpath|\bfile|\bdate|\btime|\byear|\bon\x20$"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _bound(value: str, name: str, body: str) -> str:
    """SQL of body with ``name`` standing for value, which is computed once: in a function of an array's elements the optimizer may put
    a column's own expression in the column's place, and so compute it for each element."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _span_column(text: str, number: int) -> str:
    """SQL of the matches of one generator, with their places and surroundings, as an array."""
    generator = GENERATORS[number]
    pattern = _quoted(generator.pattern)
    found = f"if({text} rlike {_quoted(generator.needs)}, regexp_extract_all({text}, {pattern}, 0), cast(array() as array<string>))"
    between = _bound(found, "h", f"named_struct('h', h, 'p', if(size(h) > 0, split({text}, {pattern}, -1), cast(array() as array<string>)))")
    lengths = _bound(between, "s", "named_struct('h', s.h, 'p', s.p, 'l', zip_with(slice(s.p, 1, size(s.h)), s.h, (p, h) -> length(p) + length(h)))")
    # places by sums of lengths: of whole blocks of 256 first, then within the block
    sums = _bound(lengths, "s", "named_struct('h', s.h, 'p', s.p, 'l', s.l, 'b', aggregate(sequence(0, size(s.l) div 256), array(0), (t, b) -> array_append(t, element_at(t, -1) + aggregate(slice(s.l, b * 256 + 1, 256), 0, (x, y) -> x + y))))")
    return _bound(sums, "s", f"""transform(s.h, (h, i) -> named_struct('kind', {KINDS.index(generator.kind)}, 'loose', {max(0, number - BASES + 1)}, 'match', h,
        'start', s.b[i div 256] + aggregate(slice(s.l, (i div 256) * 256 + 1, i % 256), 0, (x, y) -> x + y) + length(s.p[i]),
        'before', right(s.p[i], {AROUND}), 'after', left(s.p[i + 1], {AROUND})))""")


#: Of a candidate c: its digits.
DIGITS = "regexp_replace(c.match, '[^0-9]', '')"
LUHN = f"""(aggregate(sequence(1, length({DIGITS})), 0, (s, i) -> s + element_at(
    if(i % 2 = 1, array(0, 1, 2, 3, 4, 5, 6, 7, 8, 9), array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9)), cast(substr({DIGITS}, length({DIGITS}) - i + 1, 1) as int) + 1)) % 10 = 0)"""
OCTETS = r"forall(split(regexp_replace(c.match, '[:/].*$', ''), '[.]'), p -> length(regexp_replace(p, '^0+', '')) <= 3 and coalesce(try_cast(regexp_replace(p, '^0+', '') as int), 0) <= 255)"
VALID = f"""(c.loose = 0 and CASE c.kind WHEN 0 THEN true WHEN 1 THEN {OCTETS}
    WHEN 2 THEN length({DIGITS}) between 13 and 19 and {LUHN} ELSE length({DIGITS}) between 9 and 15 END)"""


def _count(pattern: str) -> str:
    return f"(length(c.match) - length(regexp_replace(c.match, {_quoted(pattern)}, '')))"


FEATURES = [
    "c.kind", "c.loose", "length(c.match)", f"length({DIGITS})", f"length(c.match) - length({DIGITS})",
    f"CASE WHEN c.kind = 2 and length({DIGITS}) between 12 and 19 THEN int({LUHN}) ELSE 0 END",
    f"CASE WHEN c.kind = 1 and c.match like '%.%' THEN int({OCTETS}) ELSE 0 END",
    "CASE c.kind " + " ".join(f"WHEN {k} THEN int(c.before rlike {_quoted(CUES[kind])})" for k, kind in enumerate(KINDS)) + " END",
    f"int(c.before rlike {_quoted(OTHER)})",
    "int(c.before rlike '[A-Za-z0-9#$_]$')", "int(c.after rlike '^[A-Za-z0-9#$_]')",
    f"size(array_distinct(split({DIGITS}, '')))",
    r"int(c.before rlike r'\+[0-9]{1,3}[\x20.-]?$')",  # the tail of an international number
    "size(array_distinct(split(left(c.match, 64), '')))",
    "int(c.match rlike '^[0-9a-fA-F]+$')",
    _count("[a-zA-Z](?=[0-9])|[0-9](?=[a-zA-Z])"),
    "size(split(c.match, ':'))", "int(c.match like '%::%')",
    _count("[./]"), _count("[A-Z]"), _count("[a-z]"), _count("[()]"),
    r"int(c.before rlike r'[=:]\x20{0,3}[\x22\x27]?$')", "int(c.after like '@%' or c.before like '%@')",
    "int(c.match rlike '(?i)(com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu)>?$')",
    r"int(c.match rlike r'^(19|20)[0-9]{2}[./\x20-]|[./\x20-](19|20)[0-9]{2}$')",  # a year in a date
]
FEATURE_ARRAY = "array(" + ", ".join(f"double({x})" for x in FEATURES) + ")"


class _Maker:
    """Labelled candidates of each of the looser generators: (match, words before, text after, label)."""

    def __init__(self, seed: int):
        self.rnd = random.Random(seed)

    def pick(self, *of: str) -> str:
        return self.rnd.choice(of)

    def digits(self, n: int) -> str:
        return "".join(self.rnd.choice("0123456789") for _ in range(n))

    def word(self, least: int = 3, most: int = 8) -> str:
        return "".join(self.rnd.choice("aeinorstlmd") for _ in range(self.rnd.randint(least, most)))

    def run(self, n: int, of: str) -> str:
        return "".join(self.rnd.choice(of) for _ in range(n))

    def luhn(self, n: int) -> str:
        prefix = self.pick("4", "5", "37", "6") + self.digits(n)
        prefix = prefix[: n - 1]
        total = sum(x if i % 2 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(prefix))))
        return prefix + str(-total % 10)

    def cue(self, likely: float, *of: str) -> str:
        return self.pick(*of) if self.rnd.random() < likely else f"{self.word()} "

    def near(self, yes: bool, loose: int) -> tuple[str, str, int]:
        """match, cue, 1 if personal. The same formats come with either label where only the company tells."""
        rnd, pick, digits, word = self.rnd, self.pick, self.digits, self.word
        kind = GENERATORS[BASES + loose - 1].kind
        other = ("version ", "order ", "invoice ", "sku ", "isbn ", "release ", "serial ", "build ", "ticket ", "ref ", "tracking ", "section ")
        if loose == 1:
            if yes:
                at, dot = pick("[at]", " (at) ", " [at] ", " at ", "{at}", " [AT] "), pick("[dot]", " (dot) ", ".", " dot ", " [dot] ")
                return f"{word()}{pick('', '.' + word(), digits(2))}{at}{word()}{dot}{pick('com', 'org', 'net', 'de', 'io', 'co.uk')}", self.cue(0.8, "mail me: ", "contact ", "write to ", "reach ", "address "), 1
            return pick(f"{word()} at {word()}.{word()}", f"{pick('x', 'y', 'i')}[at]{digits(2)}.{digits(1)}", f"{word()} at {digits(2)}.{digits(2)}", f"{word()}(at){word()}.{digits(1)}"), self.cue(0.3, "looked ", "arrived ", *other), 0
        if loose == 2:
            if yes:
                return f"{word().title()} {pick('', word().title() + ' ')}<{word()}{pick('', digits(2))}@{word()}.{pick('com', 'org', 'net', 'de')}>".replace("  ", " "), self.cue(0.6, "from ", "mail ", "contact "), 1
            return f"{word()} <{digits(rnd.randint(6, 14))}.{digits(4)}@{word()}.{pick('local', 'mx', 'id')}>", self.cue(0.6, "message id ", "ref ", "build "), 0
        if loose == 3:
            if yes:
                groups = [f"{rnd.randrange(65536):x}" for _ in range(8)]
                short = f"{pick('2001:db8', 'fe80', '2a00:' + groups[1])}::{':'.join(groups[: rnd.randint(1, 3)])}"
                return pick(":".join(groups), short), self.cue(0.6, "login from ", "server ", "host ", "client ip "), 1
            return pick(":".join(digits(2) for _ in range(pick(*"38").__len__() + rnd.choice((1, 2, 5, 7)))), ":".join(self.run(2, "0123456789abcdef") for _ in range(6)), f"{rnd.randint(0, 23)}:{digits(2)}:{digits(2)}", f"{digits(1)}:{digits(1)}:{digits(1)}"), self.cue(0.5, "at ", "time ", "ratio ", *other), 0
        if loose == 4:
            tail = pick(f":{rnd.randint(80, 65535)}", f"/{rnd.randint(8, 32)}")
            if yes:
                return ".".join(str(rnd.randint(1, 255)) for _ in range(4)) + tail, self.cue(0.6, "login from ", "server ", "host ", "client ip "), 1
            if rnd.random() < 0.5:
                return ".".join(str(rnd.randint(0, 9)) for _ in range(4)) + tail, pick("version ", "release ", "section ", "build "), 0
            return ".".join(str(rnd.randint(256, 999)) for _ in range(4)) + tail, self.cue(0.4, *other), 0
        if loose == 5:
            sep = pick("", "", " ", "-", ".", "/", "_")
            n = rnd.choice((16, 16, 16, 15, 13))
            cut = lambda d: sep.join(d[i : i + 4] for i in range(0, len(d), 4))
            if yes:
                return cut(self.luhn(n)), self.cue(0.6, "card ", "credit card ", "visa ", "pay with "), 1
            if rnd.random() < 0.3:
                return cut(self.luhn(n)), pick("order ", "tracking ", "isbn ", "serial ", "invoice "), 0
            while True:
                d = digits(rnd.randint(13, 19))
                if d[-1] != self._check(d):
                    return cut(d), self.cue(0.4, "card ", *other), 0
        if loose == 6:
            a, b, c = str(rnd.randint(2, 9)) + digits(2), digits(3), digits(4)
            if yes:
                plain = pick(f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"0{digits(2)}/{digits(3)} {digits(4)}", f"0{digits(3)} {digits(3)} {digits(3)}", f"0044 {digits(2)} {c} {c}")
                if rnd.random() < 0.5:
                    return f"({a}) {b}-{c}", self.cue(0.5, "call ", "phone ", "tel. ", "mobile: ", "fax "), 1
                return plain, pick("call ", "phone ", "tel. ", "mobile: ", "fax ", "dial "), 1
            if rnd.random() < 0.25:
                return f"({a}) {b}-{c}", f"{word()} +{rnd.randint(1, 99)} ", 0
            year = str(rnd.randint(1900, 2030))
            return pick(f"{year}-{digits(2)}-{digits(2)}", f"{digits(2)}.{digits(2)}.{year}", f"{year}-{rnd.randint(1900, 2030)}", f"{a}-{b}-{digits(5)}", f"{a} {b}", f"{digits(2)} {digits(2)}", f"{a}-{b}-{c}", f"{digits(3)} {digits(3)} {digits(3)} {digits(3)}"), self.cue(0.3, "on ", "year ") if rnd.random() < 0.4 else pick(*other), 0
        if loose == 7:
            if yes:
                return f"+{rnd.randint(1, 99)} {digits(3)} {digits(3)} {digits(4)}{pick(' x', ' ext ', ' ext. ', 'x')}{digits(rnd.randint(2, 4))}", self.cue(0.6, "call ", "phone ", "tel. "), 1
            return f"+{digits(3)} {digits(2)} {digits(3)} x {digits(1)}", pick("order ", "build ", "ref ", "sku "), 0
        if loose == 8:
            secret = pick(self.run(40, "0123456789abcdef"), self.run(32, "0123456789abcdef"), self.run(64, "0123456789abcdef"), self.run(40, "0123456789ABCDEF"), self.run(rnd.randint(20, 48), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") + "7q", "sk_live_" + self.run(24, "abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789"))
            name = pick("token", "secret", "api_key", "apikey", "access_key", "auth_token", "password", "TOKEN", "Secret")
            if yes:
                return secret, name + pick(" = ", "=", ": ", ' = "', "='", '": "'), 1
            if rnd.random() < 0.35:
                return secret, pick("commit ", "sha256 ", "md5 ", "checksum ", "build ", f"{word()} id "), 0
            return pick(self.digits(rnd.randint(16, 19)), f"//{word()}.org/{word()}/{word()}-{digits(1)}.0", f"{word()}/{word()}/{word()}{digits(2)}.txt", f"20{digits(2)}-{digits(2)}-{digits(2)}-{word()}", f"{word(8, 12)}{word(8, 12)}{digits(1)}", f"{digits(8)}-{digits(4)}-4{digits(3)}-{digits(4)}", f"{word(8, 10)}.{word(6, 9)}.{digits(2)}"), self.cue(0.3, "see ", "http:", "file ", "path ", "on "), 0
        name = pick("password", "passwd", "pwd", "token", "secret", "api_key", "Password", "auth")
        if yes:
            value = self.run(rnd.randint(6, 15), "abcdefghijklmnopqrstuvwxyz") + self.digits(rnd.randint(1, 4)) + pick("", "!", "$", "X")
            return value, name + pick(" = ", "=", ": ", ' = "', "='"), 1
        return pick(word(6, 9), f"{digits(2)}.{digits(2)}.{digits(4)}", f"{word(6, 8)}{digits(1)}", f"{word(3, 5)}.{word(3, 5)}", f"//{word()}.org", f"{digits(1)}.{digits(1)}.{digits(1)}-{word(4, 5)}"), self.word() + pick(": ", "=", " = ", ':"') if rnd.random() < 0.7 else pick("version: ", "date: ", "time: ", "path=", "build="), 0

    @staticmethod
    def _check(d: str) -> str:
        total = sum(x if i % 2 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d[:-1]))))
        return str(-total % 10)

    def one(self) -> tuple[dict, int]:
        loose = self.rnd.randint(1, len(GENERATORS) - BASES)
        match, cue, label = self.near(self.rnd.random() < 0.5, loose)
        # other words may stand between the cue and the end of the context only before it
        before = f"{self.word()} {self.word()} {cue}"[-AROUND:]
        after = self.pick(" ", ". ", ", ", '" ') + self.word() if label or self.rnd.random() < 0.85 else self.pick("#", "$", "_", "x", "7") + self.word()
        kind = KINDS.index(GENERATORS[BASES + loose - 1].kind)
        return {"kind": kind, "loose": loose, "match": match, "start": 0, "before": before, "after": after[:AROUND]}, label


def labelled(rows: int, seed: int = 7) -> list[tuple[dict, int]]:
    """Synthetic candidates of the looser generators with their labels: formats of personal data, and look-alikes."""
    maker = _Maker(seed)
    return [maker.one() for _ in range(rows)]


def _trees_sql(model: GBTClassificationModel, features: str) -> str:
    """The model's margin as a SQL expression of an array of features."""

    def node(lines: list[str]) -> str:
        if m := re.match(r"Predict: (\S+)", lines[0]):
            return repr(float(m[1]))
        indent = lambda x: len(x) - len(x.lstrip())
        k, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[0]).groups()
        other = next(i for i, x in enumerate(lines) if i and re.match(r"Else \(feature", x.strip()) and indent(x) == indent(lines[0]))
        strip = lambda block: [x[1:] for x in block]
        return f"if({features}[{k}] <= {float(bound)!r}D, {node(strip(lines[1:other]))}, {node(strip(lines[other + 1:]))})"

    found = []
    for tree, weight in zip(model.trees, model.treeWeights):
        lines = [x for x in tree.toDebugString.split("\n")[1:] if x.strip()]
        least = min(len(x) - len(x.lstrip()) for x in lines)
        found.append(f"{float(weight)!r}D * {node([x[least:] for x in lines])}")
    return " + ".join(found)


class Scorer(NamedTuple):
    margin: str  # as SQL of c.features
    thresholds: list[float]  # of each kind
    held_out: dict[str, tuple[float, float]]  # precision and recall of each kind on held-out rows


_trained: dict[str, Scorer] = {}


def scored(sample: DataFrame, margin: str) -> list:
    """kind, label and margin of labelled candidates (label, c)."""
    return sample.select("label", "c.kind", F.expr(FEATURE_ARRAY).alias("x")).select("label", "kind", F.expr(margin.replace("c.features[", "x[")).alias("margin")).collect()


def as_rows(spark: SparkSession, rows: list[tuple[dict, int]]) -> DataFrame:
    schema = "kind int, loose int, match string, start int, before string, after string, label double"
    df = spark.createDataFrame([(*c.values(), float(label)) for c, label in rows], schema).coalesce(1)
    return df.select("label", F.struct("kind", "loose", "match", "start", "before", "after").alias("c"))


def scorer(spark: SparkSession) -> tuple[str, list[float]]:
    """The margin as SQL of c.features, and the threshold of each kind."""
    return trained(spark)[:2]


def trained(spark: SparkSession) -> Scorer:
    """Trees fitted to one half of the sample, and thresholds calibrated on the other half. Once an application."""
    app = spark.sparkContext.applicationId
    if app in _trained:
        return _trained[app]
    rows = labelled(TRAINING_ROWS)
    fitted = as_rows(spark, rows[::2]).select("label", F.expr(FEATURE_ARRAY).alias("x")).select("label", array_to_vector("x").alias("features")).cache()
    model = GBTClassifier(maxIter=16, maxDepth=4, stepSize=0.3, seed=7).fit(fitted)
    fitted.unpersist()
    margin = _trees_sql(model, "x").replace("x[", "c.features[")
    held = scored(as_rows(spark, rows[1::2]), margin)
    thresholds, report = [], {}
    for k, kind in enumerate(KINDS):
        own = sorted(((r.margin, r.label) for r in held if r.kind == k), reverse=True)
        right, best = 0, (float("inf"), 1.0, 0.0)
        for i, (m, label) in enumerate(own):  # the lowest margin down to which precision holds, ties taken together
            right += label
            if right >= PRECISION * (i + 1) and (i + 1 == len(own) or own[i + 1][0] < m):
                best = m, right / (i + 1), right / max(1, sum(x for _, x in own))
        thresholds.append(best[0])
        report[kind] = best[1:]
    _trained[app] = Scorer(margin, thresholds, report)
    return _trained[app]


def with_spans(df: DataFrame, text: str, out: str = "spans") -> DataFrame:
    """Add ``out``: array of (kind, start, end, added), by kind, then start; base spans (added = 0) and those that the trees select."""
    margin, thresholds = scorer(df.sparkSession)
    names = []
    for number in range(len(GENERATORS)):
        names.append(f"__g{number}")
        df = df.withColumn(names[-1], F.expr(_span_column(text, number)))
    base, loose = names[:BASES], names[BASES:]
    span = "named_struct('kind', c.kind, 'start', c.start, 'end', c.start + length(c.match), 'added', {})"
    df = df.withColumn("__base", F.expr(f"transform(filter(concat({', '.join(base)}), c -> {VALID}), c -> {span.format(0)})")).drop(*base)
    df = df.withColumn("__more", F.expr(f"transform(concat({', '.join(loose)}), c -> named_struct('kind', c.kind, 'start', c.start, 'match', c.match, 'features', {FEATURE_ARRAY}))")).drop(*loose)
    bound = "array(" + ", ".join("double('Infinity')" if t == float("inf") else f"{t!r}D" for t in thresholds) + ")"
    df = df.withColumn("__more", F.expr(f"transform(filter(__more, c -> {margin} >= {bound}[c.kind]), c -> {span.format(1)})"))
    # a span that two generators propose counts once, as a base one if it is; equal ones are neighbours
    fresh = "i = 0 or c.kind != s[i - 1].kind or c.start != s[i - 1].start or c.end != s[i - 1].end"
    return df.withColumn(out, F.expr(_bound("array_sort(concat(__base, __more))", "s", f"filter(s, (c, i) -> {fresh})"))).drop("__base", "__more")


def _listed(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, c -> concat_ws(':', element_at(array({names}), c.kind + 1), cast(c.start as string), cast(c.end as string))), ',')"


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans; spans of all; n_added and n_secret of those added."""
    rows = with_spans(docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")), "text", "found")
    counts = [F.expr(f"cast(size(filter(found, c -> c.added = 0 and c.kind = {k})) as long)").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    more = [F.expr("cast(size(filter(found, c -> c.added = 1)) as long)").alias("n_added"), F.expr(f"cast(size(filter(found, c -> c.kind = {KINDS.index('secret')})) as long)").alias("n_secret")]
    return rows.select("doc_id", *counts, F.sha2(F.expr(_listed("filter(found, c -> c.added = 0)")), 256).alias("base_sha256"), F.expr(_listed("found")).alias("spans"), *more)


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """docs with every found span replaced by its kind in brackets; spans that overlap become one. ``length`` is set anew."""
    columns = docs.columns
    rows = with_spans(docs.withColumn("__text", text_of(text)), "__text", "__found")
    rows = rows.withColumn("__found", F.expr("array_sort(__found, (a, b) -> CASE WHEN a.start != b.start THEN if(a.start < b.start, -1, 1) WHEN a.end != b.end THEN if(a.end > b.end, -1, 1) ELSE a.kind - b.kind END)"))
    # where the spans before each one end: of whole blocks of 256 first, then within the block
    most = "coalesce(array_max(transform({}, c -> c.end)), 0)"
    ends = f"aggregate(sequence(0, size(f) div 256), array(0), (s, b) -> array_append(s, greatest(element_at(s, -1), {most.format('slice(f, b * 256 + 1, 256)')})))"
    at = f"greatest(e[i div 256], {most.format('slice(f, (i div 256) * 256 + 1, i % 256)')})"
    placed = _bound(ends, "e", f"named_struct('end', element_at(e, -1), 'spans', transform(f, (c, i) -> named_struct('kind', c.kind, 'start', c.start, 'at', {at})))")
    rows = rows.withColumn("__found", F.expr(_bound("__found", "f", placed)))
    # a place in a long text is found by its block: substr() walks from where it is applied
    rows = rows.withColumn("__blocks", F.expr(f"if(size(__found.spans) > 0, regexp_extract_all(__text, '(?s).{{1,{BLOCK}}}', 0), cast(array() as array<string>))"))

    def cut(a: str, b: str) -> str:
        first, last = f"(({a}) div {BLOCK})", f"(({b}) div {BLOCK})"
        one = lambda k: f"coalesce(get(k, cast({k} as int)), '')"
        whole = f"array_join(slice(k, cast({first} + 2 as int), cast({last} - {first} - 1 as int)), '')"
        return f"if({first} = {last}, substr({one(first)}, cast(({a}) % {BLOCK} + 1 as int), cast(({b}) - ({a}) as int)), concat(substr({one(first)}, cast(({a}) % {BLOCK} + 1 as int)), {whole}, left({one(last)}, cast(({b}) % {BLOCK} as int))))"

    tags = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    pieces = f"array_join(transform(f.spans, c -> if(c.start >= c.at, concat({cut('c.at', 'c.start')}, element_at(array({tags}), c.kind + 1)), '')), '')"
    whole = _bound("__found", "f", _bound("__blocks", "k", f"concat({pieces}, {cut('f.end', 'length(__text)')})"))
    found = F.size("__found.spans") > 0
    rows = rows.withColumn("__clean", F.when(found, F.expr(whole)).otherwise(F.col(text)))
    new = {text: F.col("__clean").alias(text)}
    if length in columns:
        new[length] = F.when(found, F.length("__clean").cast(docs.schema[length].dataType)).otherwise(F.col(length)).alias(length)
    return rows.select(*(new.get(c, F.col(c)) for c in columns))
