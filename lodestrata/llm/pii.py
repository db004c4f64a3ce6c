"""Operator 6, PII: detected entities are replaced by keyed surrogates of the same kind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

#: Fixed patterns, in order of precedence: a place belongs to the first kind that matches there.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b(?=[^A-Za-z0-9]|$)",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z+])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\+[0-9]{8,15}(?![0-9A-Za-z])|(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{4}(?![0-9A-Za-z-])",
    "female": r"(?:(?<=\bMrs\. )|(?<=\bMrs )|(?<=\bMs\. )|(?<=\bMs )|(?<=\bMiss )|(?<=\bFrau )|(?<=\bMme )|(?<=\bSra\. )|(?<=г-жа ))\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?",
    "male": r"(?:(?<=\bMr\. )|(?<=\bMr )|(?<=\bHerr )|(?<=\bM\. )|(?<=\bSr\. )|(?<=г-н ))\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?",
    "neutral": r"(?:(?<=\bDr\. )|(?<=\bDr )|(?<=\bProf\. )|(?<=\bProf ))\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?",
}
ANY = "|".join(PATTERNS.values())
#: What a text with any entity has at least; most texts have none and skip the longer pattern.
HINT = r"[0-9@]|::|\b(?:Mrs?|Ms|Miss|Frau|Herr|Mme|M|Sra?|Dr|Prof)\b|г-"
#: Names by script and gender, and the syllables of surnames; fixed lists.
GIVEN = {
    ("Latin", "female"): "Ada Alma Cora Dora Elsa Flora Greta Hanna Ida Julia Klara Lena Mara Nora Olga Petra".split(),
    ("Latin", "male"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Max Nils Otto Paul".split(),
    ("Latin", "neutral"): "Alex Charlie Dana Jamie Jordan Kim Lee Morgan Noel Pat Quinn Robin Sam Sasha Taylor Toni".split(),
    ("Cyrillic", "neutral"): "Саша Женя Валя Слава Шура Тоня Ника Мика Рика Лика Дана Лета Мира Рада Яна Зоря".split(),
    ("Cyrillic", "female"): "Анна Вера Дарья Елена Ирина Клара Лидия Мария Нина Ольга Раиса Софья Тамара Ульяна Фаина Юлия".split(),
    ("Cyrillic", "male"): "Антон Борис Вадим Глеб Денис Егор Захар Иван Кирилл Лев Марк Никита Олег Павел Роман Семён".split(),
}
SYLLABLES = {"Latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se ta te to".split(), "Cyrillic": "ба бе бо да де до за зе ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са се та те то ва ве во".split()}
#: After so many rounds the surrogates of mail addresses grow; after MOST_ATTEMPTS there are more entities than surrogates.
ATTEMPTS, MOST_ATTEMPTS = 12, 100
#: Parts of names: given names by gender, and surnames.
NAMES = ("male", "female", "neutral", "surname")


def _kind(mention: Column) -> Column:
    """The kind of a mention, by its shape alone; names are told apart by the pattern that found them."""
    out = F.when(mention.contains("@"), "email").when(mention.contains(":"), "ipv6").when(mention.rlike(r"^[A-Z]{2}[0-9]{2}"), "iban")
    out = out.when(mention.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), "ip").when(mention.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
    out = out.when(mention.rlike(r"^[0-9](?:[ -]?[0-9]){12,18}$"), "card").when(mention.rlike(r"[0-9]"), "phone")
    return out.otherwise("name")


def _norm(kind: Column, mention: Column) -> Column:
    """Mentions of one entity are equal after this: case of mails, separators of numbers don't count."""
    return F.when(kind.isin("email", "ipv6", *NAMES), F.lower(mention)).when(kind == "ip", mention).otherwise(F.regexp_replace(F.upper(mention), "[^0-9A-Z]", ""))


def _stream(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """256 keyed hexadecimal digits of an entity."""
    one = lambda i: F.sha2(F.concat_ws("|", F.lit(key), F.lit(str(i)), kind, norm, attempt.cast("string")), 256)
    return F.concat(*map(one, range(4)))


def _surrogate(key: str) -> Callable[[DataFrame], DataFrame]:
    """Adds the column surrogate, in normal form, to a table with kind, norm and attempt."""
    kind, norm, attempt = F.col("kind"), F.col("norm"), F.col("attempt")
    s = _stream(key, kind, norm, attempt)
    byte = lambda i: f"cast(conv(substring(s, 2 * pmod({i}, 128) + 1, 2), 16, 10) as int)"
    chars = "array_join(transform(sequence(1, length(norm)), i -> {}), '')"
    c = "substring(norm, i, 1)"
    letter = f"substring('abcdefghijklmnopqrstuvwxyz', {byte('i')} % 26 + 1, 1)"
    digit = f"cast({byte('i')} % 10 as string)"
    last = "length(norm) - instr(reverse(norm), '.') + 1"
    mail = chars.format(f"case when i > {last} or not {c} rlike '[a-z0-9]' then {c} when {c} rlike '[0-9]' then {digit} else {letter} end")
    iban = chars.format(f"case when i < 3 then {c} when {c} rlike '[0-9]' then {digit} else upper({letter}) end")
    phone = chars.format(f"case when i <= length(norm) - 10 then {c} when i = length(norm) - 9 or i = length(norm) - 6 then cast({byte('i')} % 8 + 2 as string) else {digit} end")
    ssn = chars.format(digit)
    # All digits but the first and last are keyed; the last makes the number pass Luhn's check exactly if the original does.
    at = lambda x: f"cast(substring({x}, length({x}) - i + 1, 1) as int)"
    luhn = lambda x: f"aggregate(sequence(1, length({x})), 0, (a, i) -> a + if(i % 2 = 1, {at(x)}, cast((2 * {at(x)}) div 10 as int) + (2 * {at(x)}) % 10))"
    body = f"concat(substring(norm, 1, 1), array_join(transform(sequence(2, length(norm) - 1), i -> {digit}), ''))"
    card = f"concat(card0, cast(pmod(-{luhn('concat(card0, 0)')} + {luhn('norm')}, 10) as string))"
    ip = f"concat_ws('.', {byte(0)} % 223 + 1, {byte(1)} % 256, {byte(2)} % 256, {byte(3)} % 254 + 1)"
    ipv6 = chars.format(f"case when {c} = ':' then {c} else lower(hex({byte('i')} % 16)) end")
    made_of = lambda script, n: f"array_join(transform(sequence(1, {n}), i -> element_at(array({', '.join(map(repr, SYLLABLES[script]))}), {byte('i')} % {len(SYLLABLES[script])} + 1)), '')"
    name = "case " + " ".join(f"when norm rlike '\\\\p{{Is{script}}}' and kind = '{gender}' then concat(lower(element_at(array({', '.join(map(repr, given))}), {byte(0)} % {len(given)} + 1)), if(attempt > 0, {made_of(script, '1 + attempt div 2')}, ''))" for (script, gender), given in GIVEN.items())
    name += " " + " ".join(f"when norm rlike '\\\\p{{Is{script}}}' then {made_of(script, '3 + attempt div 4')}" for script in SYLLABLES) + f" else {chars.format(letter)} end"
    longer = f"array_join(transform(sequence(1, attempt - {ATTEMPTS} + 1), i -> {letter}), '')"
    mail = f"concat(if(attempt >= {ATTEMPTS}, {longer}, ''), {mail})"
    made = F.when(kind == "email", F.expr(mail)).when(kind == "iban", F.expr(iban)).when(kind == "ip", F.expr(ip)).when(kind == "ipv6", F.expr(ipv6)).when(kind == "ssn", F.expr(ssn)).when(kind == "card", F.expr(card)).when(kind == "phone", F.expr(phone)).otherwise(F.expr(name))
    return lambda df: df.withColumn("s", s).withColumn("card0", F.when(kind == "card", F.expr(body))).withColumn("surrogate", made).drop("s", "card0")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm) distinct -> (kind, norm, surrogate), distinct and never a real entity, within a kind and among all names.

    Entities whose surrogate is real, taken, or also another's try again with the next keyed stream; of those that
    collide the smallest keeps it. From ATTEMPTS on mail addresses get longer, names grow anyway. An error says that a
    format has fewer surrogates than the table has entities of it.
    """
    left, make = staged(entities.select("kind", "norm").distinct()), _surrogate(key)
    group = F.when(F.col("kind").isin(*NAMES), "name").otherwise(F.col("kind")).alias("group")
    real, done = left.select(group, F.col("norm").alias("surrogate")).distinct(), None
    for attempt in range(MOST_ATTEMPTS):
        tried = staged(make(left.withColumn("attempt", F.lit(attempt))).select("kind", "norm", "surrogate", group))
        first = tried.groupBy("group", "surrogate").agg(F.min(F.struct("norm", "kind")).alias("x"))
        taken = real if done is None else real.unionByName(done.select("group", "surrogate"))
        good = staged(first.join(taken, ["group", "surrogate"], "left_anti").select("x.kind", "x.norm", "surrogate", "group"))
        done = good if done is None else done.unionByName(good)
        left = staged(tried.join(good, ["kind", "norm"], "left_anti").select("kind", "norm"))
        if left.isEmpty():
            return done.select("kind", "norm", "surrogate")
    raise RuntimeError("some format has fewer surrogates than entities")


def _formatted() -> Column:
    """The surrogate in the shape of the mention: its separators, and its capitals."""
    digits = "array_join(transform(sequence(1, length(mention)), i -> case when not substring(mention, i, 1) rlike '[0-9A-Za-z]' then substring(mention, i, 1) else substring(surrogate, length(regexp_replace(substring(mention, 1, i), '[^0-9A-Za-z]', '')), 1) end), '')"
    mail = "array_join(transform(sequence(1, greatest(length(mention), length(surrogate))), i -> case when substring(mention, i, 1) rlike '[A-Z]' then upper(substring(surrogate, i, 1)) else substring(surrogate, i, 1) end), '')"
    return F.when(F.col("kind") == "email", F.expr(mail)).when(F.col("kind").isin(*NAMES), F.initcap("surrogate")).when(F.col("kind").isin("ip", "ipv6"), F.col("surrogate")).otherwise(F.expr(digits))


def _parts(names: str, gender: str) -> Column:
    """The parts of names found after a title: (key, kind, place), a lone name being a surname, which yields to given names."""
    part = lambda key, kind, place: F.struct(key.alias("key"), F.lit(kind).alias("kind"), F.lit(place).alias("place"))
    both = lambda m: F.array(part(F.substring_index(m, " ", 1), gender, 0), part(F.substring_index(m, " ", -1), "surname", 1))
    return F.flatten(F.transform(names, lambda m: F.when(m.contains(" "), both(m)).otherwise(F.array(part(m, "surname", 2)))))


def pseudonymise(docs: DataFrame, key: str = "surrogates", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text with every detected entity replaced, n_entities.

    Kinds: mail and IP addresses, telephone, card, social security and bank account numbers, and names. A name is found
    after a title; all other mentions of its parts in the text, as whole words, count as well, so `Mr. Peter Jones`, `Peter
    Jones`, `Mr. Jones` and `Jones` agree. Names that no title in the text tells aren't found. A surrogate depends on the key
    and the entity alone, so mentions of one entity agree in all documents; it has the kind, format, script and gender of
    the original (mail addresses keep their top-level domain, numbers their separators, telephone numbers their
    country, cards Luhn's check, given names the gender of their title, none after Dr. and Prof.). Different entities get
    different surrogates and none that is a real entity of the table, see surrogates().

    Only mentions shuffle, and texts that have one; other texts pass straight through. Every pattern takes time linear in
    the text, however long its runs. Null text stays null with n_entities 0; an empty text stays empty. Repeated rows are
    replaced alike, a null doc_id stays. Further columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    has = F.coalesce(F.col("text").rlike(HINT) & F.col("text").rlike(ANY), F.lit(False))
    every = lambda p: F.regexp_extract_all("text", F.concat(F.lit("("), p, F.lit(")")), F.lit(1))
    found = rows.where(has).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h"), *(every(F.lit(PATTERNS[g])).alias(g) for g in NAMES[:3]))
    found = found.withColumn("parts", F.array_distinct(F.concat(*(_parts(g, g) for g in NAMES[:3]))))
    own = F.array_join(F.array_distinct(F.transform("parts", lambda x: x["key"])), "|")
    found = found.withColumn("pattern", F.when(F.size("parts") > 0, F.concat(F.lit(ANY + r"|(?<!\p{L})(?:"), own, F.lit(r")(?!\p{L})"))).otherwise(ANY))
    dirty = staged(found.select("doc_id", "text", "h", "parts", "pattern", every(F.col("pattern")).alias("found")))
    m = F.col("mention")
    numbers = dirty.select("h", F.explode("found").alias("mention")).select("h", "mention", _kind(m).alias("kind"), F.lit(0).alias("place")).where("kind <> 'name'")
    words = dirty.select("h", F.explode("parts").alias("x")).select("h", F.col("x.key").alias("mention"), "x.kind", "x.place")
    # Of the roles of a word in a text the first counts.
    mentions = numbers.unionByName(words).groupBy("h", "mention").agg(F.min(F.struct("place", "kind")).alias("x")).select("h", "mention", "x.kind")
    mentions = staged(mentions.withColumn("norm", _norm(F.col("kind"), m)))
    known = staged(surrogates(mentions, key))
    pairs = mentions.join(known, ["kind", "norm"]).select("h", F.struct(m.alias("key"), _formatted().alias("value")).alias("pair"))
    maps = pairs.groupBy("h").agg(F.map_from_entries(F.collect_list("pair")).alias("to"))
    # Between the mentions stand the pieces of the text; both are put together in turn.
    pieces = F.split("text", F.col("pattern"), -1)
    to = lambda x: F.expr("to")[x]
    replaced = F.transform("found", lambda x: F.when(_kind(x) == "name", F.array_join(F.transform(F.split(x, " "), lambda w: F.coalesce(to(w), w)), " ")).otherwise(to(x)))
    new = F.array_join(F.zip_with(pieces, replaced, lambda piece, x: F.concat(F.coalesce(piece, F.lit("")), F.coalesce(x, F.lit("")))), "")
    clean = dirty.join(maps, "h").select("doc_id", new.alias("text"), F.size("found").cast("long").alias("n_entities"))
    return clean.unionByName(rows.where(~has).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities")))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"))
