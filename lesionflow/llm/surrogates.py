"""Surrogates for personal data, in DataFrame expressions only.

One pattern finds e-mail addresses, IBANs, card, phone, social-security and other long numbers, IPv4
addresses, hexadecimal secrets and titled names: one or two whole words after a title, with initials before them. Each mention has a kind and a canonical form (case,
separators and titles removed where they carry no identity), and its surrogate is a function of a secret
key, the kind and the canonical form: the same entity gets the same surrogate in every document and in
every way of writing it. Digits become digits and letters letters of the same case, at the same places;
card numbers, other numbers of 13 digits or more and IBANs with valid check digits keep valid ones; octets stay octets; country codes, titles and
top-level domains stay.

A name is two entities, its given name and its family name, so that all mentions of a person agree in what they
share. The gender of a given name is that of its title; after a title that tells none it is that of the lists of
given names; else the surrogate is one of no gender. Given names come from lists by gender and script, and are built
from syllables once a list is used up; family names are built from syllables of their script.

Collisions: over all distinct entities, those whose surrogate, in the letters and digits that are written, another
entity of the kind has too, or that equals a real entity, move on to the next attempt of the keyed function until all
surrogates of a kind are distinct. Only mentions, entities and the texts that hold a mention are shuffled.

The pattern takes time in proportion to the text: no run of letters is entered twice, and all repeats are bounded. So
a local part of more than 64 letters or a label of more than 63 is no e-mail address. Null text stays null; texts without
mentions stay as they are; repeated rows are treated alike; an empty table gives no rows; further columns are
ignored by ``mask`` apart from the key and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import stash

#: What is looked for, in order of preference where several fit at one place.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){0,8}\.\p{L}{2,24}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "secret": r"\b[0-9a-fA-F]{32,64}\b",
    "ip": r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d.]*\d)",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "card": r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?\d{3}[ .-]?\d{4}|\d{2,4}(?:[ .-]?\d{2,4}){1,4})\b|\(\d{3}\) ?\d{3}-\d{4}\b|\b\d{3}[.-]\d{3}[.-]\d{4}\b",
    "number": r"\b\d{9,19}\b",
    # whole words: with inner capitals, hyphens and apostrophes (but not a possessive s), in capitals, after initials
    "name": r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sra?|Г-н|Г-жа|MR|MRS|MS|MISS|DR|PROF|HERR|FRAU|MONSIEUR|MADAME|MME|SEÑORA?|SRA?)\.? (?:\p{Lu}\.[ -]?){0,3}+WORD(?: WORD)?".replace("WORD", r"\p{Lu}(?:[\p{L}\p{M}]|-(?=\p{L})|['’](?![sS](?!\p{L}))(?=\p{L})){1,60}+"),
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: Texts without any of these hold no mention.
HINT = r"\d{3}|@|\d\.\d|[0-9a-fA-F]{32}|(?:M(?:rs?|s)|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra?|Г-н|Г-жа|MRS?|MS|MISS|DR|PROF|HERR|FRAU|MONSIEUR|MADAME|MME|SEÑORA?|SRA?)\.? "
#: A titled name's title, initials and one or two words.
NAME_PARTS = r"^([^ .]+)\.? ((?:\p{Lu}\.[ -]?)*)(\S+)(?: (\S+))?$"
#: Titles, given names and syllables.
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа")
NEUTRAL = ("Dr", "Prof")
#: Common given names that tell a gender where the title does not.
KNOWN_GIVEN = {
    "f": "Alice Amelia Amy Ana Andrea Angela Anita Anja Anna Anne Barbara Brigitte Camille Carla Carmen Carol Catherine Charlotte Christine Claire Claudia Daniela Diana Elena Elisabeth Elizabeth Ella Emily Emma Eva Eve Fiona Gabriele Grace Hannah Heike Helen Helena Ines Ingrid Irene Isabel Jane Jennifer Jessica Joan Judith Julie Karin Kate Katharina Laura Lena Linda Lisa Lucia Lucy Luisa Maria Marie Marta Martha Mary Monika Nadia Nancy Natalie Nicole Nina Olga Olivia Patricia Petra Rachel Rosa Ruth Sabine Sandra Sara Sarah Sofia Sophie Stefanie Susan Sylvia Teresa Ursula Vera Victoria Анна Вера Дарья Екатерина Елена Ирина Мария Наталья Нина Ольга Светлана Татьяна",
    "m": "Adam Alan Alexander Andreas Andrew Anthony Antonio Ben Benjamin Bernd Boris Brian Carl Carlos Charles Christian Christopher Daniel David Dieter Edward Eric Felix Fernando Francisco Frank George Hans Heinz Henri Henry Ian Jack Jacques James Jan Jean Joachim Johannes John Jonas Jorge José Joseph Juan Julian Jürgen Karl Kevin Klaus Kurt Lars Leon Luca Luis Lukas Manuel Marc Marcus Mario Mark Markus Martin Matthias Max Michael Michel Miguel Nicolas Oliver Otto Pablo Patrick Paul Pedro Peter Philip Pierre Ralf Richard Robert Samuel Sebastian Simon Stefan Stephen Steven Thomas Tim Tom Walter William Wolfgang Александр Алексей Андрей Борис Дмитрий Иван Михаил Николай Олег Павел Сергей Юрий",
}
GIVEN = {
    ("latin", "f"): "Alma Berta Clara Dora Edith Flora Greta Hanna Irma Julia Klara Laura Maria Nora Olga Paula".split(),
    ("latin", "m"): "Adam Boris Carlo David Emil Felix Georg Hugo Ivan Jakob Karl Leo Martin Nils Oscar Paul".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Клара Лидия Мария Нина Ольга Полина Раиса Софья".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Никита Олег Павел Роман Семён".split(),
}
SYLLABLES = {"latin": "ba be bo da de do fa fe ga go ka ke la le lo ma me mo na ne no ra re ro sa se so ta te to va vi".split(), "cyrillic": "ба бе бо да де до фа фе га го ка ке ла ле ло ма ме мо на не но ра ре ро са се со та те то ва ви".split()}
#: How a given name that is built from syllables ends, by script and gender.
ENDINGS = {("latin", "f"): "na", ("latin", "m"): "n", ("latin", "n"): "ri", ("cyrillic", "f"): "на", ("cyrillic", "m"): "н", ("cyrillic", "n"): "ри"}
#: The country code of an international number, by the public numbering plan, where enough digits follow to tell numbers apart.
COUNTRY = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})\d{5,}$"
#: So many rounds without fewer collisions mean that a kind has no free surrogates left.
MOST_IDLE = 24


def kind_of(mention: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed([x for x in KINDS.items() if x[0] != "name"]):
        out = F.when(F.regexp_like(mention, F.lit(f"^(?:{pattern})$")), kind).otherwise(out)
    return out


def canonical(kind: Column, mention: Column) -> Column:
    """What identifies an entity, but for names, whose parts do."""
    bare = F.regexp_replace(F.lower(mention), r"[^\p{L}\p{N}]", "")
    return F.when(kind.isin("email", "ip"), F.lower(mention)).when((kind == "phone") & F.startswith(mention, F.lit("+")), F.concat(F.lit("+"), bare)).otherwise(bare)


def parts(kind: Column, mention: Column) -> Column:
    """array<struct<kind, entity>> of a mention: one entity, but the given name (with its gender), if any, and the family name of a name."""
    title, one, two = (F.initcap(F.regexp_extract(mention, NAME_PARTS, i)) if i < 4 else F.regexp_extract(mention, NAME_PARTS, i) for i in (1, 3, 4))
    listed = {g: F.array(*map(F.lit, names.split())) for g, names in KNOWN_GIVEN.items()}
    told = F.when(F.array_contains(listed["f"], one), "f").when(F.array_contains(listed["m"], one), "m").otherwise("n")
    gender = F.when(title.isin(*FEMALE), "f").when(title.isin(*NEUTRAL), told).otherwise("m")

    def entity(k: Column | str, e: Column) -> Column:
        return F.struct((F.lit(k) if isinstance(k, str) else k).alias("kind"), e.alias("entity"))

    family = entity("family", F.lower(F.when(two != "", two).otherwise(one)))
    name = F.when(two != "", F.array(entity("given", F.concat(gender, F.lit(" "), F.lower(one))), family)).otherwise(F.array(family))
    return F.when(kind == "name", name).otherwise(F.array(entity(kind, canonical(kind, mention))))


def _byte(stream: Column, i: Column) -> Column:
    """Byte i of a hexadecimal stream, 0 to 255; the stream is used in a circle, shifted each time round."""
    n = F.length(stream).cast("int")
    at = F.pmod(i * 2 + F.floor(i * 2 / n), n - 1).cast("int")
    return F.conv(F.substring(stream, at + 1, F.lit(2)), 16, 10).cast("int")


def with_surrogate(entities: DataFrame, key: str) -> DataFrame:
    """Adds ``new``, the surrogate of (kind, entity, attempt) in canonical form. Each step is a column of its own, so that no expression repeats another."""
    stream = F.col("stream")

    def pick(chars: str, b: Column) -> Column:
        return F.substring(F.lit(chars), (b % len(chars) + 1).cast("int"), F.lit(1))

    def character(c: Column, i: Column) -> Column:
        return (
            F.when(F.contains(F.lit("0123456789"), c), pick("0123456789", _byte(stream, i)))
            .when(F.contains(F.lit("abcdefghijklmnopqrstuvwxyz"), c), pick("abcdefghijklmnopqrstuvwxyz", _byte(stream, i)))
            .when(F.regexp_like(c, F.lit(r"\p{IsCyrillic}")), pick("абвгдежзиклмнопрстуфхцчшэюя", _byte(stream, i)))
            .when(F.regexp_like(c, F.lit(r"\p{L}")), pick("abcdefghijklmnopqrstuvwxyz", _byte(stream, i))).otherwise(c)
        )

    def luhn(digits: Column, shift: int) -> Column:
        """Sum of the digits, every second one from the right (from the last for shift 1) doubled."""
        doubled = F.transform(F.reverse(digits), lambda d, i: F.when((i + shift) % 2 == 1, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)).otherwise(d.cast("int")))
        return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)

    def mod_97(iban: Column) -> Column:
        """The remainder of an IBAN, its first four characters moved to the end and letters read as 10 to 35."""
        turned = F.filter(F.split(F.concat(F.substring(iban, 5, 100), F.substring(iban, 1, 4)), ""), lambda c: c != "")
        value = F.transform(turned, lambda c: F.instr(F.lit("0123456789abcdefghijklmnopqrstuvwxyz"), c) - 1)
        return F.aggregate(value, F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97)

    def syllables(script: str, n: Column) -> Column:
        known = F.array(*map(F.lit, SYLLABLES[script]))
        return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.get(known, _byte(stream, i) % len(SYLLABLES[script]))), "")

    def given(script: str) -> Column:
        """From the list on the first attempts, built from syllables after."""
        out = F.lit(None).cast("string")
        for g in ("f", "m", "n"):
            names = GIVEN[script, g] if g != "n" else GIVEN[script, "f"] + GIVEN[script, "m"]
            listed = F.lower(F.get(F.array(*map(F.lit, names)), _byte(stream, F.lit(0)) % len(names)))
            built = F.concat(syllables(script, F.lit(2) + F.floor(F.col("attempt") / 8).cast("int")), F.lit(ENDINGS[script, g]))
            out = F.when(F.startswith("entity", F.lit(f"{g} ")), F.when(F.col("attempt") < 3, listed).otherwise(built)).otherwise(out)
        return F.concat(F.substring("entity", 1, 2), out)

    rows = entities.withColumn("seed", F.concat_ws("|", F.lit(key), "kind", "entity", F.col("attempt").cast("string")))
    rows = rows.withColumn("stream", F.concat(F.sha2("seed", 512), F.sha2(F.concat("seed", F.lit("|2")), 512)))
    rows = rows.withColumn("letters", F.filter(F.split("entity", ""), lambda c: c != ""))
    rows = rows.withColumn("fresh", F.transform("letters", character))
    rows = rows.withColumn("plain", F.array_join("fresh", ""))
    # an e-mail address keeps the last label of its domain, an IBAN its country, an international number its country code
    tail = F.regexp_extract("entity", r"(\.[^.@]*)$", 1)
    email = F.concat(F.col("plain").substr(F.lit(1), F.length("plain") - F.length(tail)), tail)
    octets = F.array_join(F.transform(F.split("entity", r"\."), lambda o, i: (_byte(stream, i) % 254 + 1).cast("string")), ".")
    secret = F.array_join(F.transform("letters", lambda c, i: pick("0123456789abcdef", _byte(stream, i))), "")
    body = F.slice("fresh", F.lit(1), F.size("fresh") - 1)
    card = F.when((F.size("letters") >= 13) & (luhn(F.col("letters"), 0) % 10 == 0), F.concat(F.array_join(body, ""), F.pmod(F.lit(10) - luhn(body, 1) % 10, F.lit(10)).cast("string"))).otherwise(F.col("plain"))
    body = F.substring("plain", 5, 100)
    check = F.lpad((F.lit(98) - mod_97(F.concat(F.substring("entity", 1, 2), F.lit("00"), body))).cast("string"), 2, "0")
    iban = F.concat(F.substring("entity", 1, 2), F.when(mod_97(F.col("entity")) == 1, check).otherwise(F.substring("plain", 3, 2)), body)
    country = F.regexp_extract("entity", COUNTRY, 1)
    phone = F.when(country != "", F.concat(F.lit("+"), country, F.col("plain").substr(F.length(country) + 2, F.lit(100)))).otherwise(F.col("plain"))
    kind = F.col("kind")
    cyrillic = F.regexp_like("entity", F.lit(r"\p{IsCyrillic}"))
    length = F.lit(4) + F.floor(F.col("attempt") / 8).cast("int")
    first, last = F.when(cyrillic, given("cyrillic")).otherwise(given("latin")), F.when(cyrillic, syllables("cyrillic", length)).otherwise(syllables("latin", length))
    new = F.when(kind == "email", email).when(kind == "ip", octets).when(kind == "secret", secret).when(kind.isin("card", "number"), card).when(kind == "iban", iban).when(kind == "phone", phone).when(kind == "given", first).when(kind == "family", last).otherwise(F.col("plain"))
    return rows.withColumn("new", new).select(*entities.columns, "new")


def with_rendered(mentions: DataFrame, key: str) -> DataFrame:
    """(mention, kind, fresh): the surrogates ``news`` of the mention's parts in its own way of writing (separators, case, title). Initials before a name become others, by the name and the key; being single
    letters, they need not be distinct."""
    mention, kind, new = F.col("mention"), F.col("kind"), F.get("news", 0)
    rows = mentions.withColumn("chars", F.filter(F.split("mention", ""), lambda c: c != ""))
    rows = rows.withColumn("kept", F.filter(F.split(F.regexp_replace(new, r"[^\p{L}\p{N}]", ""), ""), lambda c: c != ""))
    # for each letter or digit of the mention, its number among them
    rows = rows.withColumn("places", F.filter(F.sequence(F.lit(0), F.size("chars") - 1), lambda i: F.regexp_like(F.get(F.col("chars"), i), F.lit(r"[\p{L}\p{N}]"))))

    def styled(c: Column, i: Column) -> Column:
        x = F.get(F.col("kept"), F.array_position("places", i).cast("int") - 1)
        return F.when(F.array_contains("places", i), F.when(F.regexp_like(c, F.lit(r"\p{Lu}")), F.upper(x)).otherwise(x)).otherwise(c)

    rows = rows.withColumn("styled", F.array_join(F.transform("chars", styled), ""))
    names = F.initcap(F.array_join(F.transform("news", lambda n: F.regexp_replace(n, "^[fmn] ", "")), " "))
    capitals = F.regexp_like(mention, F.lit(r"\p{Lu}")) & ~F.regexp_like(mention, F.lit(r"\p{Ll}"))
    names = F.when(capitals, F.upper(names)).otherwise(names)
    chars = F.split(F.regexp_extract(mention, NAME_PARTS, 2), "")

    def initial(c: Column) -> Column:
        drawn = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.array_join("news", " "), c), 256), 1, 6), 16, 10).cast("int")
        letters = F.when(F.regexp_like(c, F.lit(r"\p{IsCyrillic}")), "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ").otherwise("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        return F.when(F.regexp_like(c, F.lit(r"\p{L}")), F.substring(letters, drawn % F.length(letters) + 1, F.lit(1))).otherwise(c)

    fresh = F.when(kind == "ip", new).when(kind == "name", F.concat(F.regexp_extract(mention, r"^(\S+ )", 1), F.array_join(F.transform(chars, initial), ""), names)).when(capitals, F.upper("styled")).otherwise(F.col("styled"))
    return rows.withColumn("fresh", fresh).select("mention", "kind", "fresh")


def written(kind: Column, form: Column) -> Column:
    """The form's letters and digits; separators tell e-mail and IP addresses apart as well."""
    return F.when(kind.isin("email", "ip"), form).otherwise(F.regexp_replace(form, r"[^\p{L}\p{N}]", ""))


def mentions_of(text: Column) -> Column:
    return F.when(F.regexp_like(text, F.lit(HINT)), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, new) of distinct (kind, entity), no two of a kind written alike and none like a real entity."""
    shape = written(F.col("kind"), F.col("new"))
    current = stash(with_surrogate(entities.withColumn("attempt", F.lit(0)), key).withColumn("form", shape))
    real = current.select("kind", written(F.col("kind"), F.col("entity")).alias("form"), F.lit(True).alias("real")).distinct()
    # The first to hold a surrogate keeps it: earlier attempts before later ones, then by the entity itself.
    turn = F.row_number().over(Window.partitionBy("kind", "form").orderBy("attempt", "entity"))
    attempt, idle, least = 0, 0, None
    while True:
        judged = current.join(real, ["kind", "form"], "left").withColumn("moves", F.col("real").isNotNull() | (turn > 1))
        moves = judged.where("moves")
        left = moves.count()
        if not left:
            return current.select("kind", "entity", "new")
        idle, least = (0, left) if least is None or left < least else (idle + 1, least)
        if idle > MOST_IDLE:
            raise ValueError(f"{left} entities find no free surrogate of their form")
        attempt += 1
        again = with_surrogate(moves.select("kind", "entity", F.lit(attempt).alias("attempt")), key).withColumn("form", shape)
        current = stash(judged.where("NOT moves").select(*current.columns).unionByName(again))


def mask(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, entities (number of mentions), kinds (sorted, distinct) and text with surrogates, per row."""
    # kept, so that the pattern runs over each text once
    rows = stash(docs.select("doc_id", "text", mentions_of(F.col("text")).alias("mentions")), compression="zstd")
    holding = rows.where(F.size("mentions") > 0).withColumn("row", F.sha2("text", 256))
    used = stash(holding.select("row", F.explode("mentions").alias("mention")).distinct())
    found = used.select("mention").distinct().withColumn("kind", kind_of(F.col("mention")))
    found = stash(found.withColumn("parts", parts(F.col("kind"), F.col("mention"))))
    pieces = found.select("mention", F.col("kind").alias("whole"), F.posexplode("parts").alias("at", "part")).select("mention", "whole", "at", "part.kind", "part.entity")
    known = pieces.join(distinct_surrogates(pieces.select("kind", "entity").distinct(), key), ["kind", "entity"])
    news = known.groupBy("mention", F.col("whole").alias("kind")).agg(F.array_sort(F.collect_list(F.struct("at", "new"))).alias("news"))
    renewed = with_rendered(news.withColumn("news", F.transform("news", lambda n: n["new"])), key)
    by_row = used.join(renewed, "mention").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("mention", F.struct("kind", "fresh")))).alias("fresh"))
    between = F.split("text", PATTERN, -1)
    text = F.array_join(F.transform(between, lambda t, i: F.concat(t, F.coalesce(F.try_element_at(F.col("fresh"), F.get(F.col("mentions"), i))["fresh"], F.lit("")))), "")
    kinds = F.array_sort(F.array_distinct(F.transform(F.map_values("fresh"), lambda v: v["kind"])))
    masked = holding.join(by_row, "row").select("doc_id", F.size("mentions").cast("long").alias("entities"), kinds.alias("kinds"), text.alias("text"))
    plain = rows.where((F.size("mentions") == 0) | F.col("mentions").isNull()).select("doc_id", F.lit(0).cast("long").alias("entities"), F.array().cast("array<string>").alias("kinds"), "text")
    return masked.unionByName(plain)
