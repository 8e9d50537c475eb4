"""Operator 2 [native]: secret scan with a random forest against false positives.

Candidates are runs of 16 or more key characters anywhere in a text, values of
any length and punctuation that follow an assignment or a quote next to a name
holding one of FOR_WORDS (up to white space; within quotes up to the closing quote
of that line, so pass phrases too), and the password of ``scheme://user:password@host``.
A forest judges each from its length, character classes and transitions, dictionary
coverage, the path (of the document, and around the candidate) and the neighbouring
words (BEFORE and AFTER characters are looked at). It is trained from labelled
findings by Spark ML and evaluated as a column expression within the row: no text is
shuffled, exploded or joined, and only texts that hold a candidate are taken apart.

Defined results: null and empty texts have no candidates and stay as they are; a
candidate that occurs several times is judged at each place and, where any place
is a secret, replaced everywhere in that text (one of under 16 characters only
where no letter or digit adjoins it); repeated rows are scanned alike;
an empty table gives no rows; a missing path column counts as an empty path.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
THRESHOLD = 0.5
MASK = "[SECRET]"
#: Parameters: words that speak for a secret near by, against one, and a small dictionary of ordinary parts.
FOR_WORDS = ("api", "apikey", "auth", "bearer", "credential", "credentials", "key", "passwd", "password", "private",
             "pwd", "secret", "token")
AGAINST_WORDS = ("checksum", "commit", "digest", "dummy", "example", "fingerprint", "hash", "id", "md5", "number",
                 "placeholder", "revision", "sample", "sha", "sha1", "sha256", "test", "uuid", "version")
DICTIONARY = ("access", "account", "article", "build", "change", "client", "code", "config", "content", "data", "date",
              "default", "demo", "dummy", "example", "file", "final", "from", "here", "host", "image", "index", "insert",
              "international", "item", "key", "link", "list", "local", "long", "mail", "main", "name", "news", "number",
              "order", "page", "path", "placeholder", "product", "public", "release", "report", "sample", "secret",
              "server", "service", "site", "some", "string", "system", "test", "text", "that", "the", "this", "title",
              "token", "update", "user", "value", "version", "with", "word", "your", "ation", "ing", "tion", "ment", "ber")
#: Names of passwords, and values that stand for one.
PASSWORD_WORDS = ("passwd", "password", "pwd")
STAND_INS = (r"(?i)^([<\[{%*].*|\$[a-z_]+|pass|pwd|[$][({].*|(.)\2*|null|none|nil|true|false|undefined|empty|required|optional|string|text|"
             r"password|passwd|secret|token|hidden|redacted|changeme|process\.env.*|os\.environ.*|self\..*|this\..*|.*[({].*)$")
#: Words of sentences: a quoted sentence holds some, a pass phrase seldom does.
_PROSE = (r"(?i)(?<![a-z])(a|an|and|are|at|be|can|der|die|das|el|en|for|from|have|if|in|is|it|la|le|les|must|not|of|on|or|please|"
          r"that|the|this|to|und|was|will|with|you|your)(?![a-z])|[.?!]$")
PATH_WORDS = r"(?i)(^|[/_.\-])(test|tests|doc|docs|example|examples|fixture|fixtures|sample|samples|mock)s?([/_.\-]|$)"
#: Context of a finding, in characters: how much before and after it is looked at.
BEFORE, AFTER = 200, 100
#: A whole identifier that holds one of FOR_WORDS (also within camel case). It is met at its first character only, so
#: a word of any length is read a fixed number of times.
_ID = r"[A-Za-z0-9_\-]"
_NAME = rf"(?<!{_ID})(?={_ID}*?(?:(?<![A-Za-z0-9])|(?<=[a-z0-9])(?=[A-Z]))(?:" + "|".join(
    f"[{w[0].upper()}{w[0]}]{w[1:]}|{w.upper()}" for w in FOR_WORDS) + rf")(?![a-z])){_ID}++[\\\"'`\])]{{0,3}}+"
_EQUALS = r"\s*+(?>:=|=>|={1,3}|:)"


def _phrase(q: str) -> str:
    """Several words between two quotes of one line, no further name and value among them."""
    return rf"(?<={q})(?=\S)(?![^{q}\r\n]*?{_NAME}{_EQUALS})[^{q}\r\n]*[^{q}\r\n\s\\](?=\\?{q})"


#: The value assigned to the name or quoted after it: to the closing quote, else up to white space.
_VALUE = (r"((?<=\")[^\s\"]*[^\s\"\\](?=\\?\")|(?<=')[^\s']*[^\s'\\](?=\\?')|(?<=`)[^\s`]+(?=`)"
          f"|{_phrase(chr(34))}|{_phrase(chr(39))}|{_phrase('`')}"
          r"|[^\s\"'`][^\s\"`]*[^\s\"'`,;.)\]}>]|[^\s\"'`,;.)\]}>])")
ASSIGNED = _NAME + rf"(?:{_EQUALS}\s*+(?:\\?[\"'`])?+|\s++\\?[\"'`])(?!{_NAME}{_EQUALS}\s)" + _VALUE
#: The password in scheme://user:password@host.
USERINFO = r"://[^\s/:@\"'`<>]*+:([^\s/\"'`<>]*[^\s/\"'`<>@])(?=@)"
FINDING = "struct<token:string,before:string,left:string,after:string,path:string>"


def _places(text: Column, pattern: str, group: int, path: Column) -> Column:
    """A finding for every match, left to right; the match must end with its group.

    The text is cut at the matches; a finding's context comes from the pieces and matches beside it, so the work
    grows with the text and the number of findings, not with their product.
    """
    empty = F.array(F.lit(""))

    def bound(value, body):  # evaluated once a text, however often the body names it
        return F.transform(F.array(value), body)[0]

    def beside(s):
        # piece i with the match ahead of it, and with the match behind it
        return F.struct(
            s["m"], s["t"],
            F.zip_with(F.concat(empty, s["m"]), s["p"], lambda m, p: F.right(F.concat(m, F.right(p, F.lit(BEFORE))), F.lit(BEFORE))).alias("tails"),
            F.zip_with(s["p"], F.concat(s["m"], empty), lambda p, m: F.left(F.concat(F.left(p, F.lit(AFTER)), m), F.lit(AFTER))).alias("heads"))

    def rows(s):
        return F.arrays_zip(s["m"].alias("m"), s["t"].alias("t"), s["tails"].alias("b1"), F.concat(empty, s["tails"]).alias("b2"),
                            F.concat(empty, empty, s["tails"]).alias("b3"), F.slice(s["heads"], F.lit(2), F.size(s["heads"])).alias("a1"),
                            F.slice(s["heads"], F.lit(3), F.size(s["heads"])).alias("a2"))

    def spaced(c):
        return F.regexp_replace(c, r"[\x20\x09-\x0D]+", " ")

    def around(s):
        name = F.left(s["m"], F.length(s["m"]) - F.length(s["t"]))
        ahead = spaced(F.concat(F.right(F.concat(s["b3"], s["b2"], s["b1"]), F.lit(BEFORE)), F.right(name, F.lit(BEFORE))))
        return F.struct(s["t"].alias("t"), ahead.alias("ahead"), F.substring_index(ahead, " ", -1).alias("before"),
                        spaced(F.left(F.concat_ws("", s["a1"], s["a2"]), F.lit(AFTER))).alias("next"))

    def finding(s):
        left = F.left(s["ahead"], F.length(s["ahead"]) - F.length(s["before"]) - 1)
        return F.struct(s["t"].alias("token"), s["before"], F.substring_index(left, " ", -2).alias("left"),
                        F.substring_index(s["next"], " ", 2).alias("after"), path.alias("path"))

    cut = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
                   F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("t"), F.split(text, pattern).alias("p"))
    # the arrays of pieces are longer than that of the matches: the last rows have none
    found = F.transform(F.transform(F.filter(bound(bound(cut, beside), rows), lambda s: s["m"].isNotNull()), around), finding)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{FINDING}>"))


def candidates(text: Column, path: Column) -> Column:
    """Array of findings: the run or value, what its word holds before it, the two words to its left, what follows it."""
    values = F.filter(_places(text, ASSIGNED, 1, path), lambda f: ~f["token"].rlike(f"^{RUN}$"))
    logins = F.filter(_places(text, USERINFO, 1, path), lambda f: ~f["token"].rlike(f"^{RUN}$"))
    return F.concat(_places(text, RUN, 0, path), values, logins)


def _any(words) -> str:
    return r"(?i)(^|[^A-Za-z0-9])(" + "|".join(words) + r")([^A-Za-z0-9]|$)"


def features(f: Column) -> Column:
    """The forest's inputs, as an array of doubles."""
    token = f["token"]
    n = F.length(token).cast("double")
    # an underscore parts words as well as a space does
    near = F.translate(F.concat_ws(" ", f["left"], f["before"]), "_", " ")

    def count(pattern, of=token):
        return F.regexp_count(of, F.lit(pattern)).cast("double")

    def flag(c):
        return c.cast("double")

    left = F.concat(f["left"], F.lit(" "), f["before"])
    return F.array(
        n,
        count("[0-9]") / n,
        count("[A-Z]") / n,
        count("[_/+=-]") / n,
        count(r"(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])") / n,
        count(r"(?i)[bcdfghjklmnpqrstvwxz](?=[aeiouy])") / n,
        F.size(F.array_distinct(F.split(token, ""))).cast("double") / n,
        flag(token.rlike("^[0-9a-f]+$")),
        1 - F.length(F.regexp_replace(F.lower(token), "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")) / n,
        flag(near.rlike(_any(FOR_WORDS))),
        flag(F.concat_ws(" ", near, f["after"]).rlike(_any(AGAINST_WORDS))),
        flag(left.rlike(r"[=:]\s*[\"'`]?$")),
        flag(f["before"].rlike(r"://|/$|\.$|@") | f["after"].rlike(r"^[.@][A-Za-z0-9]")),
        flag(f["path"].rlike(PATH_WORDS)),
        flag(token.rlike("^(AKIA|ASIA|ghp_|gho_|sk-|sk_live|xox[abp]-|eyJ)")),
        count("[^A-Za-z0-9_/+=-]") / n,
        flag(token.rlike("[a-z]")) + flag(token.rlike("[A-Z]")) + flag(token.rlike("[0-9]")) + flag(token.rlike("[^A-Za-z0-9]")),
        count("[0-9A-Z]"),
        flag(near.rlike(_any(PASSWORD_WORDS))),
        flag(left.rlike(r"=\s*[\"'`]?$|[\"'`]$")),
        flag(token.rlike(STAND_INS)),
        count(r"\s+"),
        count(_PROSE) / (1 + count(r"\s+")),
        flag(f["before"].rlike(r"://[^\s/:@]*:$") & f["after"].startswith("@")),
        flag(f["before"].rlike(r"(?i)\bdata:[a-z/+.\-]*;|base64,$")))


def labelled_findings(spark: SparkSession, each: int = 150) -> DataFrame:
    """The default labelled findings ``(token, before, left, after, path, label)``: ``each`` of every kind, by rule."""
    hexed, mixed = "sha2(concat(k, '|', id), 256)", "translate(upper(sha2(concat(k, '-', id), 256)), '0123456789ABCDEF', {})"
    upper, letters = mixed.format("'G2H4J5K7MNPQRSTV'"), mixed.format("'aG2hJ4kM7nPqR9sT'")
    word = "element_at(array('report', 'article', 'version', 'release', 'product', 'content', 'system'), 1 + cast(id % 7 AS int))"
    other = "element_at(array('ation', 'thering', 'tionment', 'release', 'number', 'image'), 1 + cast(id % 6 AS int))"
    quoted = "element_at(array('\"', '', ''''), 1 + cast(id % 3 AS int))"
    name = "element_at(array('token', 'secret', 'api_key', 'password', 'auth', 'access_token'), 1 + cast(id % 6 AS int))"
    plain = "element_at(array('and the', 'der die', 'la que', 'in of', 'on'), 1 + cast(id % 5 AS int))"
    assigned = "element_at(array('=', ':', '= ', ': '), 1 + cast(id % 4 AS int))"
    passname = "element_at(array('password', 'db_password', 'passwd', 'PWD', 'PASSWORD'), 1 + cast(id % 5 AS int))"
    loose = "element_at(array('key', 'token', 'secret', 'private', 'auth', 'api', 'password'), 1 + cast(id % 7 AS int))"
    common = "element_at(array('sunshine', 'letmein', 'dragon', 'football', 'welcome', 'shadow', 'Summer', 'hunter', 'Monkey', 'qwerty', 'iloveyou'), 1 + cast(id % 11 AS int))"
    prose = ("element_at(array('practice', 'element', 'the', 'question', 'Must', 'people', 'is', 'findings', 'a', 'Enter', 'communication', 'signature', "
             "'Choose', 'success', 'and', 'value', 'management', 'economy', 'how'), 1 + cast(id % 19 AS int))")
    stand_in = ("element_at(array('null', 'None', 'true', 'string', 'required', '<password>', '${SECRET}', '********', 'xxxxxxxx', 'changeme', "
                "'os.environ[0]', 'self.password', 'getenv(KEY)', '{{token}}', 'undefined', '...'), 1 + cast(id % 16 AS int))")
    mark = "element_at(array('!', '@', '$', '%', '~', '.', '#', '&'), 1 + cast(id % 8 AS int))"
    nodigit = "translate({}, '0123456789abcdef', 'aGbhJckMdnPqReTz')".format(hexed)
    longword = ("element_at(array('internationalization', 'Bundesverfassungsgericht', 'telecommunications', 'responsibilities', 'Geschwindigkeitsbegrenzung', "
                "'anticonstitutionnellement', 'counterproductive', 'characterization', 'Donaudampfschifffahrt', 'multidimensional', 'environmentally-friendly', "
                "'state-of-the-art', 'and/or/otherwise/maybe', 'user_account_settings', 'AbstractProxyFactoryBean', 'getElementsByTagName', "
                "'articles/international/culture', 'LinkedHashMapEntry', 'wp-content/uploads/images'), 1 + cast(id % 19 AS int))")
    diced = "array('correct', 'horse', 'battery', 'staple', 'copper', 'lantern', 'violet', 'anchor', 'tundra', 'mosaic', 'pepper', 'glacier', 'walnut')"
    phrase = "concat_ws(' ', {})".format(", ".join(f"element_at({diced}, 1 + cast((id * {m} + {m}) % 13 AS int))" for m in (1, 5, 7)))
    phrase = f"concat_ws(' ', {phrase}, if(id % 2 = 0, element_at({diced}, 1 + cast(id % 13 AS int)), NULL), if(id % 5 = 0, id, NULL))"
    sentence = ("element_at(array('The value of the setting', 'Please enter your password', 'must be at least eight characters', 'is not valid.', "
                "'Forgot your password?', 'Invalid user name or password', 'a list of names', 'Sign in with a token', 'new value for this field', "
                "'Reset password', 'at the end of the day', 'der Wert ist nicht', 'la clave no es', 'Confirm new password'), 1 + cast(id % 14 AS int))")
    zone = ("element_at(array('America/Argentina/Buenos_Aires', 'America/Los_Angeles', 'America/Indiana/Indianapolis', 'Atlantic/Reykjavik', "
            "'Australia/Melbourne', 'Asia/Ho_Chi_Minh/zone', 'Pacific/Port_Moresby', 'application/octet-stream', 'usr/local/share/zoneinfo'), 1 + cast(id % 9 AS int))")
    login = ("concat(element_at(array('postgres', 'mysql', 'redis', 'https', 'amqp', 'mongodb+srv', 'ftp'), 1 + cast(id % 7 AS int)), '://', "
             "element_at(array('user', 'admin', '', 'app', 'root'), 1 + cast(id % 5 AS int)), ':')")
    host = "concat('@', element_at(array('db', 'localhost', 'db.internal', '10.0.0.5', 'mail.example.org'), 1 + cast(id % 5 AS int)), ':5432/app')"
    kinds = [
        (1, phrase, quoted, f"concat({passname}, ' =')", quoted),
        (1, phrase, f"concat({passname}, '=', {quoted})", plain, quoted),
        (1, phrase, f"concat('secret', {assigned}, {quoted})", plain, quoted),
        (0, sentence, quoted, f"concat({loose}, ' =')", quoted),
        (0, sentence, f"concat({passname}, {assigned}, {quoted})", plain, quoted),
        (0, sentence, f"concat({loose}, {assigned}, {quoted})", plain, quoted),
        (0, phrase, f"concat(element_at(array('key', 'token', 'auth'), 1 + cast(id % 3 AS int)), {assigned}, {quoted})", plain, quoted),
        (0, zone, "element_at(array('', 'TZ=', '\"', 'zone:'), 1 + cast(id % 4 AS int))", plain, "''"),
        (0, f"substr(concat({letters}, {mixed.format("'bH3iK5lN8oQsS0uU'")}), 1, cast(40 + id AS int))", "'src=\"data:image/png;base64,'", plain, "'\"'"),
        (0, f"concat('iVBORw0KGgo', substr({letters}, 1, cast(20 + id % 40 AS int)))", "'url(data:image/gif;base64,'", plain, "')'"),
        (1, f"concat(substr({letters}, 1, cast(4 + id % 8 AS int)), {mark}, id % 100)", login, plain, host),
        (1, f"substr({hexed}, 1, cast(6 + id % 26 AS int))", login, plain, host),
        (1, f"concat({common}, id % 1000)", login, plain, host),
        (0, stand_in, login, plain, host),
        (0, "element_at(array('password', 'pass', '****', 'PASSWORD', '<password>', '$PASS', '{password}', 'xxxx', 'pwd'), 1 + cast(id % 9 AS int))", login, plain, host),
        (1, f"concat(substr({letters}, 1, cast(3 + id % 6 AS int)), {mark}, substr({hexed}, 1, cast(2 + id % 5 AS int)))", quoted, f"concat({name}, ' =')", quoted),
        (1, f"concat(substr({letters}, 1, cast(3 + id % 6 AS int)), {mark}, substr({hexed}, 1, cast(2 + id % 5 AS int)))",
         f"concat({passname}, {assigned}, {quoted})", plain, quoted),
        (1, f"concat(substr({letters}, 1, cast(8 + id % 20 AS int)), {mark}, substr({letters}, 9, cast(2 + id % 20 AS int)), {mark})",
         f"concat({name}, {assigned}, {quoted})", plain, quoted),
        (1, f"substr({letters}, 1, cast(6 + id % 10 AS int))", f"concat({name}, {assigned}, {quoted})", plain, quoted),
        (1, f"concat({common}, id % 10000, if(id % 2 = 0, {mark}, ''))", f"concat({passname}, {assigned}, {quoted})", plain, quoted),
        (1, f"concat({common}, id % 10000, if(id % 2 = 0, {mark}, ''))", quoted, f"concat({passname}, ' ', trim({assigned}))", quoted),
        (1, f"concat({common}, {mark}, id % 10000)", "'\"'", passname, "'\"'"),
        (1, common, quoted, f"concat({passname}, ' =')", quoted),
        (1, common, f"concat({passname}, '=', {quoted})", plain, quoted),
        (1, f"lpad(id * 7919 % 100000000, cast(4 + id % 5 AS int), '3')", f"concat({passname}, '=', {quoted})", plain, quoted),
        (1, f"substr({nodigit}, 1, cast(16 + id % 25 AS int))", f"concat({name}, {assigned}, {quoted})", plain, quoted),
        (1, f"substr({nodigit}, 1, cast(16 + id % 25 AS int))", quoted, f"concat({name}, ' ', trim({assigned}))", quoted),
        (0, prose, "''", f"concat({loose}, ':')", "''"),
        (0, prose, f"concat({loose}, ':')", plain, "','"),
        (0, f"concat({prose}, if(id % 3 = 0, '-', '/'), {prose})", "''", f"concat({loose}, ':')", "''"),
        (0, prose, quoted, f"element_at(array('key =', 'api', 'key', 'the token', 'auth ='), 1 + cast(id % 5 AS int))", quoted),
        (0, "cast(id % 100 AS string)", f"concat(element_at(array('key', 'token', 'auth'), 1 + cast(id % 3 AS int)), {assigned})", plain, "''"),
        (0, stand_in, quoted, f"concat({name}, ' =')", quoted),
        (0, stand_in, f"concat({passname}, {assigned}, {quoted})", plain, quoted),
        (0, longword, "''", plain, "''"),
        (0, longword, quoted, f"concat({loose}, ':')", quoted),
        (0, f"concat({longword}, '/', {longword})", "'https://www.example.com/'", plain, "'.html'"),
        (0, "repeat(element_at(array('-', '_', '/', '+', '-+'), 1 + cast(id % 5 AS int)), cast(16 + id AS int))", "''", plain, "''"),
        (1, f"substr({hexed}, 1, 40)", quoted, f"concat({name}, ' =')", quoted),
        (1, f"substr({hexed}, 1, cast(16 + id % 25 AS int))", f"concat({name}, '=')", plain, "''"),
        (1, f"substr({hexed}, 1, cast(16 + id % 17 AS int))", f"concat({name}, ':', {quoted})", plain, quoted),
        (1, f"concat('AKIA', substr({upper}, 1, 16))", quoted, plain, quoted),
        (1, f"concat('AKIA', substr({upper}, 1, 16))", "''", f"concat({name}, ' =')", "''"),
        (1, f"concat('ghp_', substr({letters}, 1, 36))", "''", plain, "''"),
        (1, f"concat('sk-', substr({letters}, 1, 40))", f"concat({name}, '=')", plain, "''"),
        (1, f"substr({letters}, 1, cast(20 + id % 30 AS int))", quoted, f"concat({name}, ' :')", quoted),
        (0, f"substr({hexed}, 1, 40)", "''", "'in commit'", "''"),
        (0, f"substr({hexed}, 1, 64)", "'sha256:'", "'image digest'", "''"),
        (0, f"substr({hexed}, 1, 32)", "''", "'md5 checksum'", "''"),
        (0, f"concat_ws('-', substr({hexed}, 1, 8), substr({hexed}, 9, 4), substr({hexed}, 13, 4), substr({hexed}, 17, 4), substr({hexed}, 21, 12))",
         "''", "'request id'", "''"),
        (0, f"substr({hexed}, 1, 40)", "''", plain, "' revision'"),
        (0, f"concat('/en/', {word}, '/', 2000 + id, '/', {other}, '-', id)", "'https://www.example.com'", plain, "'.html'"),
        (0, f"concat('your-', {word}, '-key-here-', 1000 + id)", quoted, f"concat({name}, ' =')", quoted),
        (0, "concat('example_token_', 123456 + id)", f"concat({name}, '=')", plain, "''"),
        (0, f"concat({word}, '_', {other}, '_', 2000 + id, '_final')", "''", plain, "'.txt'"),
        (0, f"concat({word}, {other}, {word}, id)", "''", plain, "''"),
        (0, "concat('20240101', lpad(id, 4, '0'), '123456')", "''", "'order number'", "''"),
        (0, f"concat({word}, '.', {other}, lpad(id, 9, '7'))", "''", plain, "'@example.com'"),
    ]
    parts = [f"SELECT {y} AS label, {t} AS token, {b} AS before, {left} AS left, {a} AS after, "
             f"CASE WHEN id % 9 = 0 THEN {'\'src/main\'' if y else '\'tests/data\''} ELSE '' END AS path "
             f"FROM (SELECT id, 'k{i}' AS k FROM range(0, {each}, 1, 1))" for i, (y, t, b, left, a) in enumerate(kinds)]
    return spark.sql(" UNION ALL ".join(parts)).coalesce(2)


def train(findings: DataFrame, trees: int = 20, depth: int = 6, seed: int = 3):
    """A random forest from labelled findings; findings without a label are left out."""
    f = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("token", "before", "left", "after", "path")])
    rows = findings.where("label IS NOT NULL AND length(token) > 0").select(F.col("label").cast("double").alias("label"), f.alias("f")) \
        .select("label", array_to_vector(features(F.col("f"))).alias("features"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(rows)


def forest_score(model, x: Column) -> Column:
    """The forest's probability of a secret, as an expression over an array of features."""

    def of(node) -> Column:
        if node.getClass().getSimpleName() == "LeafNode":
            return F.lit(float(node.impurityStats().prob(1.0)))
        split = node.split()
        return F.when(x[split.featureIndex()] <= F.lit(float(split.threshold())), of(node.leftChild())) \
            .otherwise(of(node.rightChild()))

    total = F.lit(0.0)
    for tree in model.trees:
        total = total + of(tree._java_obj.rootNode())
    return total / F.lit(float(len(model.trees)))


def scan(docs: DataFrame, model, path_col: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``__findings``: array of ``(token, before, left, after, path, score, secret)``."""
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    got = docs.withColumn("__found", candidates(text, path))
    got = got.withColumn("__x", F.transform("__found", features))
    got = got.withColumn("__p", F.transform("__x", lambda x: forest_score(model, x)))
    return got.withColumn("__findings", F.zip_with("__found", "__p", lambda f, p: F.struct(
        *[f[c].alias(c) for c in ("token", "before", "left", "after", "path")], p.alias("score"),
        (p >= F.lit(threshold)).alias("secret")))).drop("__found", "__x", "__p")


def secrets_of(findings: Column) -> Column:
    """Distinct secrets, the longest first (a secret within another goes with it)."""
    distinct = F.array_distinct(F.transform(F.filter(findings, lambda f: f["secret"]), lambda f: f["token"]))
    return F.transform(F.sort_array(F.transform(distinct, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))), asc=False),
                       lambda s: s["t"])


def redacted(text: Column, secrets: Column, mask: str = MASK) -> Column:
    def masked(t, s):
        alone = F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), F.replace(s, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z0-9])"))
        return F.when(F.length(s) < 16, F.regexp_replace(t, alone, F.lit(mask))).otherwise(F.replace(t, s, F.lit(mask)))

    return F.when(F.size(secrets) > 0, F.aggregate(secrets, text, masked)).otherwise(text)


def redact(docs: DataFrame, model, path_col: str | None = None, mask: str = MASK) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced; ``n_chars`` (if there) follows."""
    columns = docs.columns
    got = scan(docs, model, path_col).withColumn("__secrets", secrets_of(F.col("__findings")))
    got = got.withColumn("text", redacted(F.col("text"), F.col("__secrets"), mask))
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        got = got.withColumn("n_chars", F.when(F.size("__secrets") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return got.select(*[F.col(f"`{c}`") for c in columns])


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every document: candidates, secrets, and digests of the secrets and of the redacted text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    got = scan(docs, train(labelled_findings(spark)), "source").withColumn("__secrets", secrets_of(F.col("__findings")))
    return got.select("doc_id", F.size("__findings").alias("n_candidates"), F.size("__secrets").alias("n_secrets"),
                      F.sha2(F.array_join("__secrets", "\n").cast("binary"), 256).alias("secrets_sha256"),
                      F.length(redacted(F.col("text"), F.col("__secrets"))).alias("redacted_chars"))


QUERIES = {"op2_secret_scan": op2_secret_scan}
ORACLES: dict[str, str] = {}
