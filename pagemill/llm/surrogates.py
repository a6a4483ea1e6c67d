"""Personal data replaced by keyed, consistent surrogates; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.storage import Stash

# Titles by gender, and given names and surnames by gender and script, for replacements.
MALE = ("Mr", "Herr", "Monsieur", "Señor")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora")
NEUTRAL = ("Dr", "Prof")
NAMES = {
    ("given_m", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Noah Oscar Paul Rafael Simon Tobias Victor",
    ("given_f", "latin"): "Alice Bianca Clara Diana Emma Flora Greta Helena Irene Julia Karin Laura Maria Nora Olivia Paula Rosa Sofia Teresa Vera",
    ("given_n", "latin"): "Alex Charlie Dana Eden Jules Kim Lou Robin Sam Sascha",
    ("surname", "latin"): "Abel Baker Castro Dahl Egger Fischer Garcia Hansen Ibarra Jansen Keller Lang Martin Novak Ortega Peters Quint Rossi Santos Torres Ulrich Vogel Weber Young Zimmer",
    ("given_m", "cyrillic"): "Андрей Борис Виктор Дмитрий Егор Иван Лев Максим Олег Павел",
    ("given_f", "cyrillic"): "Анна Вера Дарья Елена Ирина Лидия Мария Нина Ольга Софья",
    ("given_n", "cyrillic"): "Саша Женя Валя Шура",
    ("surname", "cyrillic"): "Белик Волк Гончар Дубко Коваль Лысенко Мороз Новак Остап Шевчук",
}
# Letters that names in other scripts are made of.
LETTERS = {
    "greek": "αεηικλμνοπρστυ", "armenian": "աբգդեզիլկհմնոպսվտր", "georgian": "აბგდევზთიკლმნოპრსტ", "arabic": "ابتجدرسعفقكلمنهوي", "hebrew": "אבגדהזחטילמנסעפקרש",
    "devanagari": "अकगचजतदनपबमयरलवसह", "hangul": "가나다라마바사아자하고노도로모보소오조호", "kana": "あいうえかきくけさしすたちてとなにはまみやゆらりアイウエカキクサシスタチテナニハマミヤユラリ", "han": "王李張劉陳楊黃趙吳周徐孫馬朱胡林郭何高羅",
}
_BLOCK = {"greek": r"\p{IsGreek}", "armenian": r"\p{IsArmenian}", "georgian": r"\p{IsGeorgian}", "arabic": r"\p{IsArabic}", "hebrew": r"\p{IsHebrew}", "devanagari": r"\p{IsDevanagari}", "hangul": r"\p{IsHangul}", "kana": r"\p{IsHiragana}\p{IsKatakana}", "han": r"\p{IsHan}"}
_CASELESS = "".join(_BLOCK[x] for x in ("georgian", "arabic", "hebrew", "devanagari"))
_DENSE = "".join(_BLOCK[x] for x in ("hangul", "kana", "han"))
_TITLE = "|".join((*MALE, *FEMALE, *NEUTRAL))
#: A name: a capital and more letters, with parts behind hyphens and apostrophes; letters of a script without case; up to four of one without blanks.
_NAME = rf"(?:\p{{Lu}}(?:[\p{{L}}\p{{M}}]+(?:['’\-]\p{{Lu}}[\p{{L}}\p{{M}}]+)*|(?:['’]\p{{Lu}}[\p{{L}}\p{{M}}]+)+)|[{_CASELESS}][\p{{L}}\p{{M}}]+|[{_DENSE}]{{2,4}})"
_INITIAL = r"\p{Lu}\."

#: What is replaced, by kind. In a text they are tried in this order at each place.
KINDS = {
    "key": r"\bAKIA[A-Z0-9]{16}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?=(?: ?[A-Z0-9]){11,30}\b)(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "secret": r"\b(?:password|passwd|token|secret|api_key)\s{0,3}[=:]\s{0,3}\"?[A-Za-z0-9_\-]{8,128}\"?",
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,8}",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5}|[Ff][CcDdEe][0-9A-Fa-f]{2}:(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "ip": r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d.]*\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-]*\d)",
    "card": r"(?<![\d\-])\d{4}(?:[ \-]?\d{4}){2}[ \-]?\d{1,4}(?![\d\-]*\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)|\d{3,4})[ .\-]\d{3,4}[ .\-]\d{3,4}(?!\d)|(?<![\d+])\+\d{9,15}(?!\d)",
    "name": rf"\b(?:{_TITLE})\.? (?:(?:{_NAME}|{_INITIAL}) ){{0,2}}{_NAME}",
}
#: Within a word no kind begins but at a digit, a plus or a parenthesis: most places fail on this alone.
PATTERN = rf"(?:(?<![A-Za-z])|(?=[\d+(]))(?:{'|'.join(KINDS.values())})"
#: A text without any of these has no match, and most texts are told by them in less time.
_WORDS = ("@", "password", "passwd", "token", "secret", "api_key", *MALE, *FEMALE, *NEUTRAL)
_RUNS = r"\d[\d .\-()]{5}|:[0-9A-Fa-f]{0,4}:|[A-Z]{2}\d\d|AKIA"
#: Rounds in a row that settle no entity, after which a format counts as full: numbers keep their lengths, so more than
#: half of all numbers of a format can't be replaced by others of it.
ROUNDS = 40


def maybe(text: Column) -> Column:
    """What every text with a match meets."""
    out = text.rlike(_RUNS)
    for w in _WORDS:
        out = out | text.contains(w)
    return out


def _kind(m: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in list(KINDS.items())[-2::-1]:
        out = F.when(m.rlike(rf"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _secret_value(m: Column) -> Column:
    return F.regexp_extract(m, r"[=:]\s*\"?([A-Za-z0-9_\-]+)", 1)


def _names(m: Column) -> Column:
    """Roles and canonical values of a titled name's words, its title and initials left out."""
    words = F.slice(F.split(m, " "), F.lit(2), F.size(F.split(m, " ")))
    role = lambda i: F.when(i == F.size(words) - 1, "surname").otherwise("given")
    each = F.transform(words, lambda w, i: F.struct(role(i).alias("role"), F.lower(w).alias("value")))
    return F.filter(each, lambda x: ~x["value"].endswith("."))


def _parts(m: Column) -> Column:
    """The entities of a match, as structs of role and canonical value: what has one surrogate everywhere."""
    kind = _kind(m)
    plain = F.when(kind.isin("card", "phone", "ssn"), _digits(m)).when(kind == "secret", _secret_value(m)).when(kind.isin("email", "ipv6"), F.lower(m)).when(kind == "iban", F.replace(m, F.lit(" "), F.lit(""))).otherwise(m)
    return F.when(kind == "name", _names(m)).otherwise(F.array(F.struct(kind.alias("role"), plain.alias("value"))))


def _gender(m: Column) -> Column:
    title = F.regexp_extract(m, rf"^({_TITLE})\b", 1)
    return F.when(title.isin(*MALE), "m").when(title.isin(*FEMALE), "f")


def _stream(key: str) -> Column:
    """128 hexadecimal characters that depend on the key, the entity and the attempt."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), "role", "value", F.col("attempt").cast("string")), 512)


def _same_classes(value: Column, h: Column, free: Column) -> Column:
    """Another string with a digit for each digit and a letter of its case for each letter.

    Where ``free`` holds, or no character is a letter or digit, any character becomes a small letter or a digit.
    """
    free = free | ~value.rlike("[0-9A-Za-z]")

    def char(i: Column) -> Column:
        c = F.substring(value, i, F.lit(1))
        x = F.conv(F.substring(h, (i * 2) % 126 + 1, F.lit(2)), 16, 10).cast("int")
        pick = lambda pool: F.substring(F.lit(pool), (x % len(pool)) + 1, F.lit(1))
        return F.when(free, pick("abcdefghijklmnopqrstuvwxyz0123456789")).when(c.rlike("[0-9]"), pick("0123456789")).when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1))), char), "")


def _number(n: Column, h: Column) -> Column:
    return F.substring(F.translate(h, "abcdef", "024689"), F.lit(1), n)


def _luhn(body: Column) -> Column:
    """The digits with the check digit that card numbers end with."""

    def add(s: Column, i: Column) -> Column:
        d = F.substring(body, F.length(body) - i, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return s + F.when(i % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), F.length(body) - 1), F.lit(0), add)
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def _iban(v: Column, h: Column) -> Column:
    """An account number of the same country and form, with its check digits."""
    body = _same_classes(F.substring(v, F.lit(5), F.length(v)), h, F.lit(False))
    whole = F.concat(body, F.substring(v, 1, 2), F.lit("00"))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(F.split(whole, ""), lambda c: c != ""), F.lit(0), lambda r, c: (r * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)
    return F.concat(F.substring(v, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), body)


def _pick(pool: Column, h: Column, i: Column) -> Column:
    """Of the values in pool one that the i-th seven digits of h choose."""
    return F.element_at(pool, F.conv(F.substring(h, i * 8 + 1, F.lit(7)), 16, 10).cast("int") % F.size(pool) + 1)


def _name(h: Column, v: Column, attempt: Column) -> Column:
    """A name in the script of v. Latin and Cyrillic ones come from lists, by gender; first one, then joined ones, as long as it takes."""
    script = F.lit("latin")
    for of, block in ({"cyrillic": r"\p{IsCyrillic}"} | _BLOCK).items():
        script = F.when(v.rlike(f"[{block}]"), of).otherwise(script)
    role = F.when(F.col("role") == "given", F.concat(F.lit("given_"), F.coalesce("gender", F.lit("n")))).otherwise("surname")
    pool = F.lit(None).cast("array<string>")
    for (of_role, of), names in NAMES.items():
        pool = F.when((role == of_role) & (script == of), F.array(*map(F.lit, names.split()))).otherwise(pool)
    count = F.when(attempt == 0, 1).when(attempt < 6, 2).when(attempt < 12, 3).when(attempt < 18, 6).otherwise(16)
    listed = F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda i: _pick(pool, h, i)), "-")
    letters = F.lit(None).cast("array<string>")
    for of, each in LETTERS.items():
        letters = F.when(script == of, F.array(*map(F.lit, each))).otherwise(letters)
    n = F.least(F.greatest(F.length(v), F.when(script.isin("han", "hangul", "kana"), 2).otherwise(4)) + F.floor(attempt / 3).cast("int"), F.lit(16))
    spelt = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: _pick(letters, h, i)), "")
    # Georgian capitals aren't used at the start of names alone
    spelt = F.when(script.isin("greek", "armenian"), F.initcap(spelt)).otherwise(spelt)
    return F.when(script.isin("latin", "cyrillic"), listed).otherwise(spelt)


def _surrogate(key: str) -> Column:
    """The surrogate of (role, value, gender) at (attempt). Later attempts choose from more surrogates, so that every entity settles."""
    h, v, n, attempt = _stream(key), F.col("value"), F.length("value"), F.col("attempt")
    octet = lambda i: (F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("int") % 254 + 1).cast("string")
    local, domain = F.substring_index(v, "@", 1), F.element_at(F.array(*(F.lit(f"mail{i}.example.{d}") for i in range(8) for d in ("org", "net"))), F.conv(F.substring(h, 127, 2), 16, 10).cast("int") % 16 + 1)
    numbered = F.concat(F.lit("mail"), F.conv(F.substring(h, F.lit(115), F.when(attempt < 6, 4).otherwise(12)), 16, 10), F.lit(".example.org"))
    phone = F.concat(F.substring(v, F.lit(1), F.greatest(n - 10, F.lit(0))), F.lit("2"), _number(F.least(n, F.lit(10)) - 1, h))
    out = F.when(F.col("role") == "email", F.concat(_same_classes(local, h, F.lit(False)), F.lit("@"), F.when(attempt < 3, domain).otherwise(numbered)))
    out = out.when(F.col("role") == "ip", F.concat_ws(".", F.when(attempt < 6, "10").otherwise(octet(3)), octet(0), octet(1), octet(2)))
    groups = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.substring(h, i * 4 + 1, F.lit(4)))
    hexed = F.array_join(F.transform(F.split(v, ""), lambda c, i: F.when(c.rlike("[0-9a-f]") & ~((i < 4) & v.rlike("^f[c-f]")), F.substring(h, i + 1, F.lit(1))).otherwise(c)), "")
    out = out.when(F.col("role") == "ipv6", F.when(attempt < 6, hexed).otherwise(F.concat(F.lit("fd00:"), F.array_join(groups, ":"))))
    out = out.when(F.col("role") == "iban", _iban(v, h))
    out = out.when(F.col("role") == "card", _luhn(F.concat(F.substring(v, 1, 1), _number(n - 2, h))))
    out = out.when(F.col("role") == "phone", F.when(attempt < 6, phone).otherwise(_number(n, h)))
    out = out.when(F.col("role") == "ssn", F.when(attempt < 6, F.concat(F.lit("9"), _number(F.lit(8), h))).otherwise(_number(F.lit(9), h)))
    out = out.when(F.col("role") == "key", F.concat(F.lit("AKIA"), F.upper(F.substring(h, 1, 16)))).when(F.col("role") == "secret", F.when(v.rlike("^[0-9a-f]{8,128}$"), F.substring(h, F.lit(1), n)).otherwise(_same_classes(v, h, attempt >= 3)))
    return out.otherwise(_name(h, v, attempt))


def surrogates(entities: DataFrame, key: str, stash: Stash) -> DataFrame:
    """(role, value, surrogate) of distinct entities (role, value, gender): no two of a role share one, and none is another's value.

    In each round the entities whose surrogate collides try the next one; of those that share one,
    the entity with the fewest attempts, then the least value, keeps it. The rounds go on until every entity has its own.
    """
    made = _surrogate(key)
    now = stash.put("try", entities.withColumn("attempt", F.lit(0)).withColumn("surrogate", made))
    shape = F.lower("surrogate")
    before, idle = -1, 0
    while idle < ROUNDS:
        owner = now.groupBy("role", shape.alias("s")).agg(F.min(F.struct("attempt", "value")).alias("o"), F.count("*").alias("n")).where("n > 1").select(F.col("role").alias("r1"), "s", F.col("o.value").alias("owner"))
        real = now.select(F.col("role").alias("r2"), F.lower("value").alias("v2")).distinct()
        lost = now.join(owner, (F.col("role") == F.col("r1")) & (shape == F.col("s")), "left").join(real, (F.col("role") == F.col("r2")) & (shape == F.col("v2")), "left")
        bad = (F.col("owner").isNotNull() & (F.col("owner") != F.col("value"))) | F.col("v2").isNotNull()
        new = stash.put("try2", lost.withColumn("bad", bad).withColumn("attempt", F.col("attempt") + F.col("bad").cast("int")).select("role", "value", "gender", "attempt", F.when(F.col("bad"), made).otherwise(F.col("surrogate")).alias("surrogate"), "bad"))
        left = new.where("bad").count()
        stash.drop("try")
        stash.paths["try"] = stash.paths.pop("try2")
        now = new.drop("bad")
        if not left:
            return now.select("role", "value", "surrogate")
        before, idle = left, idle + 1 if left == before else 0
    raise RuntimeError(f"{left} entities have formats that are full")


def _filled(m: Column, digits: Column, of=None) -> Column:
    """The match's punctuation with other digits (or what ``of`` takes), one for one."""
    of = of or (lambda c: c.rlike("[0-9]"))

    def step(s: Column, c: Column) -> Column:
        is_digit = of(c)
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substring(digits, s["i"], F.lit(1))).otherwise(c)).alias("out"), (s["i"] + is_digit.cast("int")).alias("i"))

    return F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("i")), step)["out"]


def _in_case(s: Column, like: Column) -> Column:
    """A surrogate in capitals where the name stands in capitals."""
    return F.when((F.upper(like) == like) & (F.lower(like) != like), F.upper(s)).otherwise(s)


def _rendered(m: Column, known: Column, key: str) -> Column:
    """What stands for a match, given the document's map from role and value to surrogate."""
    kind = _kind(m)
    of = lambda role, value: known[F.concat_ws("|", role, value)]
    words = F.split(m, " ")
    last = F.size(words) - 1
    initial = lambda w: F.concat(F.chr(F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}\x1f"), w), 256), 1, 4), 16, 10).cast("int") % 26 + 65), F.lit("."))
    word = lambda w, i: F.when(i == 0, w).when(w.rlike(rf"^{_INITIAL}$"), initial(w)).otherwise(_in_case(of(F.when(i == last, "surname").otherwise("given"), F.lower(w)), w))
    titled = F.array_join(F.transform(words, word), " ")
    secret = F.concat(F.regexp_extract(m, r"^(.*?[=:]\s*\"?)", 1), of(kind, _secret_value(m)), F.when(m.endswith('"'), F.lit('"')).otherwise(""))
    # a mention without a title; a person's name without one is that of the surname, else of the given name
    alone = _in_case(F.coalesce(of(F.lit("surname"), F.lower(m)), of(F.lit("given"), F.lower(m))), m)
    number = lambda c: c.rlike("[0-9A-Z]")
    iban = _filled(m, of(kind, F.replace(m, F.lit(" "), F.lit(""))), number)
    plain = of(kind, F.when(kind.isin("email", "ipv6"), F.lower(m)).otherwise(m))
    is_titled = m.rlike(rf"^(?:{KINDS['name']})$")
    return F.when(kind == "name", F.when(is_titled, titled).otherwise(alone)).when(kind.isin("card", "phone", "ssn"), _filled(m, of(kind, _digits(m)))).when(kind == "iban", iban).when(kind == "secret", secret).otherwise(plain)


def _with_mentions(known: Column) -> Column:
    """PATTERN, and a document's known names where they stand without a title."""
    names = F.array_distinct(F.transform(F.filter(F.map_keys(known), lambda k: k.rlike("^(?:surname|given)[|]")), lambda k: F.substring_index(k, "|", -1)))
    # the longest first, so that no name is taken for the beginning of another
    names = F.transform(F.reverse(F.array_sort(F.transform(names, lambda n: F.struct(F.length(n).alias("l"), n.alias("n"))))), lambda x: x["n"])
    spaced, dense = F.filter(names, lambda n: ~n.rlike(f"[{_DENSE}]")), F.filter(names, lambda n: n.rlike(f"[{_DENSE}]"))
    after = rf"(?![\p{{L}}\p{{M}}]|['’\-]\p{{Lu}})"
    spaced = F.when(F.size(spaced) > 0, F.concat(F.lit(rf"|(?<![\p{{L}}\p{{M}}])(?=[\p{{Lu}}{_CASELESS}])(?iu:"), F.array_join(spaced, "|"), F.lit(f"){after}"))).otherwise("")
    dense = F.when(F.size(dense) > 0, F.concat(F.lit("|(?:"), F.array_join(dense, "|"), F.lit(")"))).otherwise("")
    return F.concat(F.lit(PATTERN), spaced, dense)


def replace_personal_data(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with its texts' personal data replaced, and the column ``n_replaced``.

    KINDS says what is found; a name found under a title is also found elsewhere in its document, beginning with a
    capital or all in capitals. Each entity (an e-mail address in any case, a number in any
    punctuation, a surname, a given name) has one surrogate in the whole corpus, from
    a hash with ``key``: of the same kind, format and script, and of the gender that all its titles agree on. Collisions are
    checked over all entities, so distinct ones stay distinct and no surrogate is another
    entity's value; initials, which tell nobody apart, are not checked. Texts without personal data stay as they are, byte for byte.

    Null and empty texts stay; rows that repeat get equal results; an empty table gives an empty
    one; a column ``n_replaced`` of ``docs`` is replaced, others are kept. Texts are told apart by doc_id and a 64-bit hash.
    """
    stash = Stash(docs.sparkSession, "personal")
    keep = [c for c in docs.columns if c != "n_replaced"]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep])
    hit = F.coalesce(maybe(F.col("text")) & F.col("text").rlike(PATTERN), F.lit(False))
    some = rows.where(hit).select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("found"), F.xxhash64("text").alias("told"))
    some = stash.put("some", some)
    parts = some.select(F.col("doc.doc_id").alias("d"), "told", F.explode(F.array_distinct("found")).alias("m")).select("d", "told", _gender(F.col("m")).alias("gender"), F.explode(_parts(F.col("m"))).alias("p"))
    parts = stash.put("parts", parts.select("d", "told", "p.role", "p.value", F.when(F.col("p.role") == "given", F.col("gender")).alias("gender")).distinct())
    gender = F.when(F.min("gender") == F.max("gender"), F.min("gender")).alias("gender")
    made = surrogates(parts.groupBy("role", "value").agg(gender), key, stash)
    known = parts.select("d", "told", "role", "value").distinct().join(made, ["role", "value"]).groupBy("d", "told").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "role", "value"), "surrogate"))).alias("known"))
    done = some.join(known, F.col("doc.doc_id").eqNullSafe(F.col("d")) & (some["told"] == known["told"])).select("doc", "known")
    named = F.exists(F.map_keys("known"), lambda k: k.startswith("surname|"))
    done = done.withColumn("pattern", F.when(named, _with_mentions(F.col("known"))).otherwise(PATTERN))
    done = done.select("doc", "known", F.regexp_extract_all("doc.text", "pattern", F.lit(0)).alias("found"), F.split("doc.text", F.col("pattern"), -1).alias("pieces"))
    new = F.transform("found", lambda m: _rendered(m, F.col("known"), key))
    joined = F.concat(F.array_join(F.transform(new, lambda s, i: F.concat(F.col("pieces")[i], s)), ""), F.element_at("pieces", -1))
    done = done.select(*[(joined if c == "text" else F.col(f"doc.`{c}`")).alias(c) for c in keep], F.size("found").cast("long").alias("n_replaced"))
    return rows.where(~hit).withColumn("n_replaced", F.lit(0).cast("long")).unionByName(done)
