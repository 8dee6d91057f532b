"""Secret scans: a regular expression proposes candidates, a random forest removes the false positives.

Everything is a DataFrame expression: one pass of the regular expression marks the candidates of a text, neighbouring
words and features are array expressions of the row, and the forest is compiled into one SQL ``CASE`` expression. The scan
is therefore a single narrow pass without a shuffle; text never leaves the JVM. Only training runs jobs of its own, over a
bounded table of labelled findings.

Candidates have no upper length: private keys as whole blocks; prefixes that are issued; any value that is assigned to a
key that names a secret, quoted or not; other quoted values and values behind ``=`` from 8 characters; runs of 16 or more
token characters with a digit. Quoted text that no such key names and that holds blanks is prose and no candidate.

Features: length, shares of character classes, class transitions, distinct characters, coverage by dictionary words,
shape (hex, UUID, issued prefix, reference to a variable), an assignment and telling words among the neighbouring words,
and the path. Neighbours are whole words, however long.

Defined results: a null text has no findings; a null path is the empty path; an empty table gives an empty result;
repeated rows are scanned each on its own; other columns pass through ``redact`` and never reach ``scan``.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, numbered, text_of

#: Words that name a secret, words that name something public, words of identifiers.
SECRET_WORDS = "access.?key|api.?key|auth|bearer|client.?secret|credential|passphrase|passwd|password|private.?key|pwd|secret|token"
PUBLIC_WORDS = "build|checksum|commit|digest|etag|example|fingerprint|guid|hash|id|invoice|md5|order|placeholder|request|revision|sample|sha1|sha256|trace|uuid|version"
DICTIONARY = (
    "about account address admin after all and any api app are auth back bar base before branch build but cache call change changeme check class client code color config "
    "content copy count create current data date default delete demo dev dist docs down dummy else email empty env environ error example false file first font for form from "
    "get getenv guide has have header here home host html http icon image import index info input insert is it item java key label last left lib line link list load local "
    "log login main make me message method model module my name new next no node none not null number object of old on online only open option or os other page param password "
    "path phone php place private public query random read release report request required result right role root run sample save script secret select self server service "
    "session set site size some source start state static status step str string style sub system table tag temp test text that the there this time title to token top true "
    "type undefined update url use user value var version view was web when width will with word work world write xml xxxx year you your zone"
)
PUBLIC_PATHS = "test|spec|example|fixture|sample|docs?/|readme|node_modules|vendor|\\.lock|\\.min\\.|changelog"
ISSUED = "^(AKIA[0-9A-Z]{12}|gh[pousr]_|xox[abprs]-|sk_live_|AIza|eyJ[A-Za-z0-9_-]+|-----BEGIN )"
MARK = "[SECRET]"
THRESHOLD = 0.5

_BOUND = "PRIVATE KEY[A-Z ]*+-----"
_EVEN = r"(?<=[^\\](?:\\\\){0,32})"  # an even number of backslashes, or none, before a quote
#: (what stands before, the candidate) of each kind; a match is both, in groups of their own. No kind repeats a group, so that long texts need no stack.
KINDS = (
    # a private key to its closing line, or as far as its lines go
    ("", rf"-----BEGIN [A-Z0-9 ]*?{_BOUND}(?:[\r\n]*+(?:Proc-Type:[^\n]*+\n)?+(?:DEK-Info:[^\n]*+\n)?+[^-]*+-----END [A-Z0-9 ]*?{_BOUND}|[A-Za-z0-9+/=\r\n]*(?=[\r\n]|$)|)"),
    # prefixes that are issued
    ("", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+)"),
    # a value assigned to a key that names a secret: quoted, to the quote that no backslash escapes; else to white space, or to what begins another value
    (rf"(?=[abcpstABCPST])(?i:{SECRET_WORDS})[\w.-]*+[\"']?+[ \t]*+(?:=>|:=|==?|:)[ \t]*+(?:(?i:bearer|basic|token)[ \t]++)?+[\"']?+", rf"(?!\[SECRET\])(?:(?<=\")(?!\")[^\n]+?(?=\"){_EVEN}|(?<=')(?!')[^\n]+?(?='){_EVEN}|(?![\"',;)>])\S+?(?=[\"',;)>]{{0,8}}+(?:\s|$)|&[\w.-]{{1,64}}+=|</|[,;][\w.-]{{1,64}}+[=:]))"),
    # the password of a URL, and what stands in an element that names a secret
    (r"(?<=[a-z0-9])://[^\s/:@<>\"']{0,64}+:", r"(?!\[SECRET\])[^\s/@\"'<>]++(?=@)"),
    (rf"<(?i:{SECRET_WORDS})[\w.-]*+>[ \t]*+", r"(?!\[SECRET\])[^\s<>][^<>\n]*+(?=</)"),
    # another quoted value that is no key; one behind =; a run of token characters with a digit
    ("", r"(?<=[\"'])(?!\[SECRET\])[^\"'\s]{8,}+(?=[\"'](?!\s*+:))|(?<==)[^\s\"'&;,<>()]{8,}+|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}"),
)
#: What every text with a candidate holds, found in a fraction of the time.
HINT = "[0-9=:\"']|</|AKIA|gh[pousr]_|xox|-----BEGIN "
CANDIDATE = "|".join(f"({before})({found})" for before, found in KINDS)
#: What surrounds a candidate while a text is cut: a noncharacter, which texts do not hold. A text that does is cut by positions.
_CUT = "\ufdd0"
_SURROUNDED = "".join(f"${2 * i + 1}" for i in range(len(KINDS))) + _CUT + "".join(f"${2 * i + 2}" for i in range(len(KINDS))) + _CUT
#: Words of context on each side.
WORDS = 4
#: Labelled findings that the forest is fitted on at most, its trees and their depth.
MAX_FINDINGS, TREES, DEPTH = 6000, 25, 7

FEATURES = "length digits upper lower other transitions distinct dictionary hex uuid issued variable assigned secret_word public_word public_path".split()


def _features(found: Column, left: Column, right: Column, path: Column) -> Column:
    """The feature array of one candidate, in the order of ``FEATURES``."""
    n = F.length(found).cast("double")
    share = lambda pattern: F.regexp_count(found, F.lit(pattern)) / n
    flag = lambda c: c.cast("double")
    near = F.lower(F.concat_ws(" ", left, right))
    words = F.split(F.lower(F.regexp_replace(found, "([a-z])([A-Z])", "$1 $2")), "[^a-z]+")
    known = F.aggregate(F.filter(words, lambda w: w.isin(*DICTIONARY.split())), F.lit(0), lambda a, w: a + F.length(w))
    return F.array(
        n,
        share("[0-9]"),
        share("[A-Z]"),
        share("[a-z]"),
        share("[^A-Za-z0-9]"),
        share("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        F.size(F.array_distinct(F.split(found, ""))) / F.least(n, F.lit(64.0)),
        known / n,
        flag(found.rlike("^[0-9a-fA-F]+$")),
        flag(found.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
        flag(found.rlike(ISSUED)),
        flag(found.rlike("^[$%{<*\\[]|\\w[.]\\w|[\\[\\]{}]$")),
        flag(left.rlike("(=|:|>)\\s*(?i:bearer |basic |token )?[\"']?$")),
        flag(F.lower(left).rlike(f"(?:{SECRET_WORDS})[\\w.-]*+\\W*(?:(?:bearer|basic|token)\\s+)?[\"']?$|://[^\\s:/@]*:$")),
        flag(near.rlike(f"(?<![a-z])(?:{PUBLIC_WORDS})(?![a-z])")),
        flag(F.lower(path).rlike(PUBLIC_PATHS)),
    )


#: In SQL over h and b, 65 to 320 hex digits and base64 characters.
_LONG_H, _LONG_B = (f"left(repeat({c}, 8), 65 + cast(conv(left(h, 2), 16, 10) as int))" for c in "hb")
#: Shapes of labelled findings as (secret, left, candidate in SQL over h and b, right, path). h: 64 hex digits, b: 43 base64 characters.
LABELLED = (
    (1, 'token = "', "left(h, 40)", '"', "src/app.py"),
    (1, 'token = "', "left(h, 40)", '" of the', "src3"),
    (1, "{w} {w} secret: '", "left(h, 32)", "' {w}", ""),
    (1, 'api_key="', "left(b, 32)", '"', "config/settings.py"),
    (1, "export API_KEY=", "left(b, 40)", " {w}", "deploy.sh"),
    (1, 'password = "', "concat(left(b, 9), '!', right(b, 4))", '"', "src/db.go"),
    (1, "passwd: '", "concat(left(h, 6), '#', left(b, 7))", "'", "conf/app.yml"),
    (1, "Authorization: Bearer ", "concat('eyJ', b)", " {w}", "logs/http.txt"),
    (1, "{w} {w} ", "concat('AKIA', upper(left(h, 16)))", " {w}", "notes"),
    (1, "{w} ", "concat('ghp_', left(b, 36))", " {w}", "src7"),
    (1, "access_key => '", "concat('sk_live_', left(b, 24))", "'", "billing.rb"),
    (1, "{w}\n", "'-----BEGIN RSA PRIVATE KEY-----'", "\n", "id_rsa"),
    (1, "client_secret: ", "left(b, 30)", "\n{w}", "app.yaml"),
    (1, "{w} {w} password=", "left(h, 18)", " {w}", "src8"),
    (1, "{w}. PASSWORD=", "concat(left(b, 8), '!', left(h, 3))", " {w}", "src2"),
    (1, "token=", "left(h, 32)", "&{w}", "notes"),
    (0, "commit ", "left(h, 40)", " by {w}", "src3"),
    (0, "sha256: ", "h", "\n", "package.lock"),
    (0, "{w} checksum ", "left(h, 32)", " {w}", "README.md"),
    (0, 'id="', "concat(left(h, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12))", '"', "src/page.html"),
    (0, "{w} {w} ", "translate(left(h, 16), 'abcdef', '012345')", " {w} {w}", "src1"),
    (0, "card ", "translate(left(h, 16), 'abcdef', '987654')", " {w}", "src12"),
    (0, 'token = "', "'your_token_here_example_1'", '"', "docs/guide.md"),
    (0, 'password = "', "'changeme_example_password1'", '"', "README.md"),
    (0, "api_key = '", "'xxxxxxxxxxxxxxxx0000'", "'", "tests/test_api.py"),
    (0, 'class="', "'header-login-form-2-column'", '"', "src/page.html"),
    (0, 'src="', "'/static/image/icon-home-32.png'", '"', "src/page.html"),
    (0, 'token = "', "left(h, 40)", '"', "tests/fixtures/sample.py"),
    (0, "{w} ", "concat('/usr/lib/service/version', left(translate(h, 'abcdef', '012345'), 3), '/index')", " {w}", "src4"),
    (0, "{w} '", "'message_{w}_content_2'", "' {w}", "src/i18n.py"),
    (0, "version: ", "concat('release-', left(translate(h, 'abcdef', '012345'), 8), '-build')", " {w}", "changelog"),
    (0, "{w} {w} ", "left(h, 32)", " {w}", "src9"),
    (0, "{w} page=", "concat('section-', left(h, 2), '-overview')", " {w}", "src5"),
    (0, "{w}?ref=", "concat('newsletter_', translate(left(h, 4), 'abcdef', '012345'))", " {w}", "src5"),
    (0, "{w} width=", "concat('calc-100-percent-', left(h, 1))", " {w}", "style.css"),
    (0, 'href="', "'http://site.example/page?item=12345'", '"', "src/page.html"),
    (1, "{w} token=", _LONG_H, " {w}", "src6"),
    (0, "{w} ", _LONG_H, " {w}", "src6"),
    (1, 'api_key = "', f"concat('eyJ', left(b, 33), '.', {_LONG_H}, '.', b)", '"', "src/app.py"),
    (1, "{w} ", f"concat('ghp_', {_LONG_H})", " {w}", "notes"),
    (0, 'src="', f"concat('data:image/png;base64,', {_LONG_B})", '"', "src/page.html"),
    (1, "{w} ", f"concat('xoxb-', {_LONG_H})", " {w}", "src10"),
    (1, '{"client_secret": "', "left(h, 40)", '"}', "config/app.json"),
    (0, '{"{w}": "{w}", "sha256": "', "h", '"}', "package.json"),
    (1, '{"id": 7, "password": "', "left(h, 32)", '", "{w}": 1}', "src11"),
    (0, '{"commit_id": "', "left(h, 40)", '", "{w}": "', "src3"),
    (1, '"client_id": "{w}", "access_token": "', "left(b, 40)", '"', "src13"),
    (0, '{"secret": "{w}", "checksum": "', "left(h, 32)", '"}', "src11"),
    (1, "{w} ", f"concat('-----BEGIN RSA PRIVATE KEY-----', chr(10), 'MII', {_LONG_B}, chr(10), b, chr(10), '-----END RSA PRIVATE KEY-----')", " {w}", "src14"),
    (1, "password: ", "concat(left(h, 4), '!', left(b, 6), '#')", "\n{w}", "app.yaml"),
    (1, "{w} {w} api_key: ", "concat('k', left(h, 11))", " {w}", "src15"),
    (1, "{w} password=", "concat('{w}', left(translate(h, 'abcdef', '123456'), 2))", " {w}", "src16"),
    (1, "{w} pwd: ", "left(b, 8)", "\n", "conf/app.yml"),
    (1, 'passphrase = "', "concat('{w} ', left(h, 2), ' {w}{w} ', left(b, 3))", '"', "src/vault.py"),
    (1, "secret => '", "concat(left(b, 5), '$', left(h, 5))", "'", "billing.rb"),
    (1, "{w} postgres://{w}:", "concat(left(b, 6), '%', left(h, 4))", "@{w}:5432/{w}", "src17"),
    (1, "https://{w}:", "concat('{w}', left(translate(h, 'abcdef', '123456'), 1), '{w}')", "@{w}.example/{w}", "src18"),
    (1, "<{w}><password>", "concat(left(b, 8), '#', left(h, 3))", "</password>", "conf/app.xml"),
    (1, "{w} password: ", "concat(left(b, 5), '&', left(h, 3), ';', left(b, 4))", " {w}", "src19"),
    (1, "api_key: ", "concat(left(h, 3), '(', left(b, 1), ')', left(b, 9))", "\n", "conf/app.yml"),
    (1, "password = \"", "concat(left(b, 4), chr(92), '\"', left(h, 5), ',', left(b, 5))", "\"", "src/db.go"),
    (0, "{w} password=", "'get_{w}(user,{w})'", "\n", "src/api.py"),
    (0, "<{w}><token>", "'{w}'", "</token>", "docs/page.xml"),
    (0, '{w} = "', "concat(left(translate(h, '0123456789', 'ghijklmnop'), 7), left(translate(h, 'abcdef', '012345'), 1))", '"', "src/app.py"),
    (0, '{w}="', "concat(left(translate(h, '0123456789', 'ghijklmnop'), 9), left(translate(h, 'abcdef', '012345'), 2))", '" {w}', "src20"),
    (0, '{w} = "{w}""', "concat(left(translate(h, '0123456789', 'ghijklmnop'), 8), left(translate(h, 'abcdef', '012345'), 1))", '""{w}"', "src21"),
    (0, "{w} token: ", "'{w}'", " {w} {w}", "src1"),
    (0, "{w} the password: ", "'{w}{w}{w}'", " {w}", "src2"),
    (0, "{w} the secret = ", "'{w}{w}'", " {w}", "src2"),
    (0, "password = ", "element_at(array('None', 'null', 'true', 'false', 'undefined', 'str', 'string', 'required'), 1 + cast(conv(substr(h, 5, 2), 16, 10) as int) % 8)", ",", "src/app.py"),
    (0, "api_key: ", "concat('$', '{', upper('{w}'), '_KEY}')", "\n", "app.yaml"),
    (0, "token = ", "'os.environ[{w}.key]'", " {w}", "src/app.py"),
    (0, "password=", "'config.get_password'", " {w}", "src/db.go"),
    (0, "{w} tokens: ", "left(translate(h, 'abcdef', '012345'), 3)", " {w}", "src3"),
    (0, "auth = ", "'request.headers.auth'", "\n", "src/api.py"),
    (0, 'password: "', "'Enter your password here'", '"', "src/i18n.py"),
    (0, "secret: ", "'********'", " {w}", "logs/app.txt"),
)


def labelled_findings(spark: SparkSession, n: int = MAX_FINDINGS) -> DataFrame:
    """(found, left, right, path, secret): ``n`` labelled findings, made by rule from the shapes above."""
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
    word = "concat_ws('', transform(sequence(1, 2), i -> element_at(array('the', 'and', 'ing', 'er', 'on', 'ti', 'enz', 'ung', 'ver', 'que'), 1 + cast(conv(substr(h, 60 - i, 1), 16, 10) as int) % 10)))"
    filled = lambda s: f"replace({quote(s)}, '{{w}}', {word})"
    shapes = ", ".join(f"named_struct('found', replace({found}, '{{w}}', {word}), 'left', {filled(left)}, 'right', {filled(right)}, 'path', {quote(path)}, 'secret', {secret}D)" for secret, left, found, right, path in LABELLED)
    made = spark.range(0, n, 1, 1).selectExpr("id", "sha2(concat('finding-', id), 256) h").selectExpr("id", "h", "translate(left(base64(unhex(h)), 43), '+/', 'xY') b")
    return made.selectExpr(f"inline(array(element_at(array({shapes}), cast(1 + id % {len(LABELLED)} as int))))")


def fit(findings: DataFrame) -> RandomForestClassificationModel:
    """A forest on labelled findings (found, left, right, path, secret), at most ``MAX_FINDINGS`` of them."""
    rows = findings.limit(MAX_FINDINGS).select(array_to_vector(_features(F.col("found"), F.col("left"), F.col("right"), F.col("path"))).alias("features"), F.col("secret").cast("double").alias("label"))
    rows = rows.coalesce(1).cache()  # training reads them several times
    try:
        return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, minInstancesPerNode=4).fit(rows)
    finally:
        rows.unpersist()


def compiled(model: RandomForestClassificationModel, features: str) -> str:
    """The forest as SQL: the share of its trees that vote for a secret, from the array ``features``."""

    def tree(lines: list[str]) -> str:
        line = lines.pop(0).strip()
        if line.startswith("Predict"):
            return f"{float(line.split(':')[1])}D"
        _, number, compare, value = re.match(r"If \((feature (\d+)) (<=|>) ([^)]+)\)", line).groups()
        yes = tree(lines)
        lines.pop(0)  # the Else line
        return f"CASE WHEN {features}[{number}] {compare} {float(value)!r}D THEN {yes} ELSE {tree(lines)} END"

    votes = [tree(t.toDebugString.strip().split("\n")[1:]) for t in model.trees]
    return f"({' + '.join(votes)}) / {len(votes)}D"


@cache
def _default_forest(application: str) -> str:
    spark = SparkSession.getActiveSession()
    return compiled(fit(labelled_findings(spark)), "x.features")


def _parts(body: Column) -> Column:
    """The text before the first candidate, the candidate, the text up to the next, and so on: an odd number of strings."""
    return F.when(body.rlike(HINT), F.split(F.regexp_replace(body, CANDIDATE, _SURROUNDED), _CUT, -1)).otherwise(F.array(body))


def _starts(parts: Column) -> Column:
    """How many code points stand before each part: sums over chunks of the square root of their number, then within a chunk."""
    once = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    lengths = F.transform(parts, lambda p: F.length(p))

    def chunked(x: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(x["n"]) - 1) / x["k"]).cast("int")), lambda c: total(F.slice(x["n"], c * x["k"] + 1, x["k"])))
        return once(sums, lambda s: F.struct(x["n"].alias("n"), x["k"].alias("k"), F.transform(s, lambda _, c: total(F.slice(s, F.lit(1), c))).alias("base")))

    def placed(x: Column) -> Column:
        return F.transform(x["n"], lambda _, i: F.get(x["base"], F.floor(i / x["k"]).cast("int")) + total(F.slice(x["n"], i - i % x["k"] + 1, i % x["k"])))

    return once(once(once(lengths, lambda n: F.struct(n.alias("n"), F.ceil(F.sqrt(F.size(n))).cast("int").alias("k"))), chunked), placed)


def _first_words(piece: Column) -> Column:
    return F.substring_index(F.ltrim(F.translate(piece, "\t\r\n", "   ")), " ", WORDS)


def _last_words(piece: Column) -> Column:
    """The last words of a piece; white space at its end is kept, one blank for each."""
    return F.substring_index(F.translate(piece, "\t\r\n", "   "), " ", -WORDS - 1)


def _found(df: DataFrame, text: str, path: str | None, forest: str | None) -> DataFrame:
    """``df`` with __parts, texts and candidates in turn, and __findings, the candidates with positions in code points and scores."""
    forest = forest or _default_forest(df.sparkSession.sparkContext.applicationId)
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    body = text_of(text)
    # exploding a list of one keeps the optimizer from cutting the text anew for each use of its parts; lambdas refer to
    # their own arguments alone, since what they took from outside would be computed for each element
    df = df.withColumn("__parts", F.explode(F.array(_parts(F.replace(body, F.lit(_CUT), F.lit(" "))))))
    df = df.withColumn("__at", F.explode(F.array(_starts(F.col("__parts")))))
    own = F.zip_with("__parts", "__at", lambda p, at: F.substring(body, at + 1, F.length(p)))
    df = df.withColumn("__parts", F.explode(F.array(F.when(body.contains(_CUT), own).otherwise(F.col("__parts")))))
    odd = lambda a: F.filter(a, lambda _, i: i % 2 == 1)
    even = lambda a: F.filter(a, lambda _, i: i % 2 == 0)
    n = F.floor(F.size("__parts") / 2).cast("int")
    before = F.slice(even(F.col("__parts")), 1, n)
    cut = F.arrays_zip(odd(F.col("__parts")).alias("found"), odd(F.col("__at")).alias("start"), before.alias("before"), F.slice(even(F.col("__parts")), 2, n).alias("right"))
    df = df.withColumn("__cut", F.explode(F.array(cut)))
    # the words before a candidate: those behind the candidate before it, and what stands before that
    df = df.withColumn("__ends", F.explode(F.array(F.transform("__cut", lambda x: _last_words(F.concat(x["before"], x["found"]))))))
    shifted = [F.concat(F.array_repeat(F.lit(""), F.least(n, F.lit(k))), F.slice("__ends", 1, F.greatest(n - k, F.lit(0)))).alias(f"end{k}") for k in range(WORDS, 0, -1)]
    df = df.withColumn("__near", F.arrays_zip(F.col("__cut").alias("cut"), *shifted))

    def seen(x: Column) -> Column:
        left = _last_words(F.concat(*[x[f"end{k}"] for k in range(WORDS, 0, -1)], x["cut"]["before"]))
        return F.struct(x["cut"]["found"].alias("found"), x["cut"]["start"].alias("start"), left.alias("left"), _first_words(x["cut"]["right"]).alias("right"), where.alias("path"))

    df = df.withColumn("__seen", F.transform("__near", seen))
    df = df.withColumn("__seen", F.transform("__seen", lambda x: F.struct(x["found"].alias("found"), x["start"].alias("start"), _features(x["found"], x["left"], x["right"], x["path"]).alias("features"))))
    scored = F.expr(f"transform(__seen, x -> named_struct('start', x.start, 'stop', x.start + length(x.found), 'found', x.found, 'score', {forest}))")
    return df.withColumn("__findings", F.explode(F.array(scored)))


def scan(df: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = "source", forest: str | None = None) -> DataFrame:
    """(doc_id, start, stop, candidate, score, is_secret): each candidate of each text, in code points, stop exclusive."""
    columns = [F.col(key).cast("long").alias("doc_id"), F.col(text).alias("__text"), *([F.col(path).alias("__path")] if path else [])]
    found = _found(df.select(*columns), "__text", "__path" if path else None, forest)
    rows = found.select("doc_id", F.explode("__findings").alias("f"))
    return rows.select("doc_id", F.col("f.start").cast("long").alias("start"), F.col("f.stop").cast("long").alias("stop"), F.col("f.found").alias("candidate"), F.col("f.score").alias("score"), (F.col("f.score") >= THRESHOLD).alias("is_secret"))


def redact(df: DataFrame, text: str = "text", path: str | None = "source", chars: str | None = "n_chars", forest: str | None = None) -> DataFrame:
    """``df`` with every secret in its text replaced by ``MARK``; rows and columns stay, ``chars`` is counted anew where the text changed."""
    plain, own = numbered(df)
    found = _found(plain, own[text], own[path] if path else None, forest)
    scores = F.concat(F.array(F.lit(0.0)), F.flatten(F.transform("__findings", lambda f: F.array(f["score"], F.lit(0.0)))))  # of each part
    shown = F.zip_with("__parts", scores, lambda p, score: F.when(score >= THRESHOLD, MARK).otherwise(p))
    changed = F.exists("__findings", lambda f: f["score"] >= THRESHOLD)
    found = found.withColumn("__new", F.when(changed, F.array_join(shown, "")))
    out = {text: F.coalesce("__new", own[text])}
    if chars in own:
        out[chars] = F.coalesce(F.length("__new").cast(df.schema[chars].dataType), own[chars])
    return named(found, own, **out)
