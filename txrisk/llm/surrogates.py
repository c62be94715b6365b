"""Operator 10: surrogates for personal data, in DataFrame functions only.

Detected entities are replaced by keyed ones of the same type: digits by
digits, letters by letters of their script and case, separators and lengths as
they were; cards keep their first digit and a valid check digit, addresses of
machines stay valid, names keep title, gender ending and script.  The
replacement depends on key, type and the entity's normal form, so mentions of
one entity in other formats or cases stay one.  All distinct entities are
checked: two entities that meet in a replacement, or a replacement that is
itself an entity of the corpus, make another attempt until none do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.spark_io import materialize

# FIXED VALUES: what is looked for; the first alternative that fits decides.
_EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}+@[\p{L}\p{N}\-]{1,63}(?:\.[\p{L}\p{N}\-]{1,63}){1,8}+"
_IP = r"(?<![\p{L}\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\p{L}\d]|\.\d)"
_SSN = r"(?<![\p{L}\d\-])\d{3}-\d{2}-\d{4}(?![\p{L}\d\-])"
_AMERICAN = (r"(?<![\p{L}\d(])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?![\p{L}\d])"
             r"|(?<![\p{L}\d.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\p{L}\d\-])")
_NATIONAL = (r"0[1-9](?:[ .\-]?\d{2}){4}"  # fr
             r"|(?:\(0\d{2,4}\) ?|0\d{2,4}(?: ?[/\-] ?| ))\d{3,8}(?:[ \-]\d{2,5}){0,3}+|01[5-7]\d{8,9}"  # de
             r"|[6-9]\d{2}(?:(?:[ .\-]\d{3}){2}|(?:[ .\-]\d{2}){3})|[89]\d[ .\-]\d{3}(?:[ .\-]\d{2}){2}")  # es
_PHONE = (r"(?<![\p{L}\d+])\+\d{1,3}[ .\-]?(?:\(0\) ?)?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,4}+(?![\p{L}\d])|" + _AMERICAN
          + r"|(?<![\p{L}\d.,+\-/(])(?:" + _NATIONAL + r")(?![\p{L}\d]|[.,\-/]\d)")
_CARD = r"(?<![\p{L}\d])(?:\d{4}(?:[ \-]\d{4}){3}|\d{13,19})(?![\p{L}\d])"
_IBAN = r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?(?![\p{L}\d])"
_SECRET = (r"(?<![\p{L}\d])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}"
           r"|sk-[A-Za-z0-9]{20,64})(?![\p{L}\d])")
_TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "г-н"],
           "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "г-жа"], "": ["Dr", "Prof"]}
_TITLE = r"(?:(?:" + "|".join(t for ts in _TITLES.values() for t in ts) + r")\.? )"
# words that end a name though they are capitalised: days, months, sentence starts
_STOPS = ("Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August "
          "September October November December Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag Januar "
          "Februar März Mai Juni Juli Oktober Dezember Lundi Mardi Mercredi Jeudi Vendredi Samedi Dimanche Janvier "
          "Février Mars Avril Juin Juillet Août Septembre Octobre Novembre Décembre Lunes Martes Miércoles Jueves "
          "Viernes Sábado Domingo Enero Febrero Marzo Abril Mayo Junio Julio Agosto Septiembre Noviembre Diciembre "
          "And But The On In At He She They It We When Then After Before").split()
_CAPITAL = r"(?!(?:" + "|".join(_STOPS) + r")(?![\p{L}\p{N}]))(?=\p{Lu}[\p{L}\p{M}'’\-])\p{Lu}[\p{L}\p{M}]*+(?:['’\-]\p{L}[\p{L}\p{M}]++)*+"
_BETWEEN = (r"(?:(?:\p{Lu}\.|van|von|vom|der|den|dem|des|de|del|della|di|da|do|dos|das|du|la|le|les|los|las|zu|zum|zur"
            r"|ten|ter|te|y|e|bin|ibn|al|el|af|av|фон|де|дер) )")  # initials and particles
_NAME = r"(?<![\p{L}])" + _TITLE + "+" + _BETWEEN + "*" + _CAPITAL + "(?: " + _BETWEEN + "*" + _CAPITAL + ")*"
_BARE = r"(?<![\p{L}\p{N}\p{M}])" + _CAPITAL  # may be a name met before
KINDS = {"email": _EMAIL, "secret": _SECRET, "iban": _IBAN, "card": _CARD, "ssn": _SSN, "ip": _IP,
         "phone": _PHONE, "name": _NAME}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
HINT = (r"[@\d]|sk-|gh[pousr]_|AKIA|[a-f]{32}|[A-F]{32}|"
        + "|".join(t for ts in _TITLES.values() for t in ts))  # a text without it has no entity
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_SCRIPTS = {"Cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "Greek": "αβγδεζηθικλμνξοπρστυφχψω"}
_SYLLABLES = {"": "ba be bo da de di do fa fe ga go ka ke la le li lo ma me mi mo na ne no pa ra re ri ro sa se ta te "
                  "ti to va vi".split(),
              "Cyrillic": "ба бе бо ва ве ви га го да де ди до за зо ка ке ла ле ли ло ма ме ми мо на не но па ра ре ри "
                          "ро са се та те ти то".split()}
_ENDINGS = {"": {"m": "n", "f": "ra", "": "s"}, "Cyrillic": {"m": "в", "f": "ва", "": "к"}}
WIDEN = 8       # attempts in the entity's own format before it may grow
MOST_ATTEMPTS = 40


def _kind(m: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, p in reversed(list(KINDS.items())):
        out = F.when(m.rlike(f"^(?:{p})$"), F.lit(name)).otherwise(out)
    return out


def _places(s: Column) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1)))


def _draw(i: Column, n) -> Column:
    """A number below n from two hex digits of column ``h`` at place i."""
    return F.conv(F.substr(F.col("h"), (i * 2) % 126 + 1, F.lit(2)), 16, 10).cast("int") % n


def _pick(alphabet: str, k: Column) -> Column:
    return F.substr(F.lit(alphabet), k + 1, F.lit(1))


def _luhn(digits: Column) -> Column:
    """Sum of a card number's digits as its check digit needs it (``n`` digits)."""
    def part(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).try_cast("int")
        doubled = (F.col("n") - i) % 2 == 1
        return F.coalesce(d + F.when(doubled, d - F.when(d > 4, 9).otherwise(0)).otherwise(0), F.lit(0))
    return F.aggregate(F.transform(_places(digits), part), F.lit(0), lambda a, x: a + x)


def _same_form(norm: Column) -> Column:
    """Character by character; reads the columns h, n, head, tail and hexes."""
    def one(i: Column) -> Column:
        c = F.substr(norm, i, F.lit(1))
        low = F.lower(c)
        letter = F.when(F.col("hexes"), _pick("abcdef", _draw(i, 6)))
        for script, alphabet in _SCRIPTS.items():
            letter = letter.when(low.rlike(r"\p{Is" + script + "}"), _pick(alphabet, _draw(i, len(alphabet))))
        letter = letter.otherwise(_pick(_LOWER, _draw(i, 26)))
        return (F.when((i <= F.col("head")) | (i > F.col("n") - F.col("tail")), c)
                .when(c.rlike("^[0-9]$"), _draw(i, 10).cast("string"))
                .when(c.rlike(r"^\p{L}$"), F.when(c != low, F.upper(letter)).otherwise(letter)).otherwise(c))
    return F.array_join(F.transform(_places(norm), one), "")


def _machine(norm: Column) -> Column:
    """An address whose parts stay valid and as long; any part once it may grow."""
    def octet(p: Column, i: Column) -> Column:
        d = _draw(i * 2, 256) * 256 + _draw(i * 2 + 1, 256)
        return (F.when(F.col("attempt") >= WIDEN, d % 256).when(F.length(p) == 3, 100 + d % 156)
                .when(F.length(p) == 2, 10 + d % 90).otherwise(d % 10)).cast("string")
    return F.array_join(F.transform(F.split(norm, r"\."), octet), ".")


def _word(script: str) -> Column:
    """A name in a script; given names end by their gender."""
    syl = F.array(*[F.lit(x) for x in _SYLLABLES[script]])
    body = F.transform(F.sequence(F.lit(1), 3 + F.floor(F.col("attempt") / 4).cast("int")),
                       lambda i: F.element_at(syl, _draw(i, len(_SYLLABLES[script])) + 1))
    ends = _ENDINGS[script]
    end = F.when(F.col("kind") == "given_m", ends["m"]).when(F.col("kind") == "given_f", ends["f"]).otherwise(ends[""])
    return F.initcap(F.concat(F.array_join(body, ""), end))


def with_surrogate(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (kind, norm, attempt) with ``new``, the replacement of the normal form."""
    kind, norm = F.col("kind"), F.col("norm")
    rows = rows.select(
        "kind", "norm", "attempt",
        F.sha2(F.concat_ws("|", F.lit(key), kind, norm, F.col("attempt").cast("string")).cast("binary"), 512).alias("h"),
        F.length(norm).alias("n"),
        F.when(kind == "card", 1).when(kind == "iban", 2).when(
            kind == "secret", F.length(F.regexp_extract(norm, r"^(AKIA|gh[pousr]_|sk-|)", 1))).otherwise(0).alias("head"),
        F.when(kind == "email", F.length(F.regexp_extract(norm, r"(\.[^.]*)$", 1))).otherwise(0).alias("tail"),
        ((kind == "secret") & norm.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")).alias("hexes"))
    rows = rows.withColumn("same", _same_form(norm))
    base = F.substr(F.col("same"), F.lit(1), F.col("n") - 1)
    check = ((10 - _luhn(F.concat(base, F.lit("0"))) % 10) % 10).cast("string")
    rows = rows.withColumn("same", F.when((kind == "card") & (_luhn(norm) % 10 == 0), F.concat(base, check))
                           .otherwise(F.col("same")))
    more = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.col("attempt") - WIDEN + 1, F.lit(1))),
                                    lambda i: (_draw(i + 30, 9) + 1).cast("string")), "")
    new = (F.when(kind == "ip", _machine(norm))
           .when(kind.isin("given", "given_m", "given_f", "surname"),
                 F.when(norm.rlike(r"\p{IsCyrillic}"), _word("Cyrillic")).otherwise(_word("")))
           .when(F.col("attempt") >= WIDEN, F.concat(more, "same")).otherwise(F.col("same")))
    return rows.select("kind", "norm", "attempt", new.alias("new"))


def _matches(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(
        F.array().cast("array<string>"))


def mention_table(docs: DataFrame) -> DataFrame:
    """text_key, m: the different mentions in each different text."""
    text = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").rlike(HINT))
    return (text.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key"),
                        F.explode(F.array_distinct(_matches(F.col("text")))).alias("m")).distinct())


def normal_forms(mentions: DataFrame) -> DataFrame:
    """m, kind, norm: the entity a mention names, the same for all mentions of it;
    names have no norm but entities of their own (``name_parts``)."""
    m, kind = F.col("m"), F.col("kind")
    digits = F.regexp_replace(m, r"\D", "")
    # without the country and the trunk's 0, where these are known
    phone = (F.when(m.rlike(f"^(?:{_AMERICAN})$"), F.right(digits, F.lit(10)))
             .when(m.rlike(r"^\+(?:33|34|49)"), F.regexp_replace(digits, "^(?:33|34|49)0?", ""))
             .when(m.startswith("+"), F.right(digits, F.lit(10))).otherwise(F.regexp_replace(digits, "^0", "")))
    norm = (F.when(kind == "phone", phone).when(kind.isin("card", "ssn"), digits)
            .when(kind == "iban", F.regexp_replace(m, " ", "")).when(kind == "email", F.lower(m))
            .when(kind == "name", F.lit(None)).otherwise(m))
    return mentions.select("m").distinct().withColumn("kind", _kind(m)).select("m", "kind", norm.alias("norm"))


def name_parts(forms: DataFrame) -> DataFrame:
    """m, titles, place, part, kind, norm: the words of names; particles have no kind."""
    m, part = F.col("m"), F.col("part")
    title = F.regexp_extract(m, r"^([^ .]+)", 1)
    given = F.when(title.isin(*_TITLES["m"]), "given_m").when(title.isin(*_TITLES["f"]), "given_f").otherwise("given")
    rest = F.regexp_replace(m, f"^{_TITLE}+", "")
    words = F.split(rest, " ")
    kind = F.when(part.rlike(r"^\p{Lu}"), F.when(F.col("place") == F.col("last"), "surname").otherwise(F.col("given")))
    return (forms.where("kind = 'name'")
            .select("m", F.substr(m, F.lit(1), F.length(m) - F.length(rest)).alias("titles"), given.alias("given"),
                    (F.size(words) - 1).alias("last"), F.posexplode(words).alias("place", "part"))
            .select("m", "titles", "place", "part", kind.alias("kind"), F.lower("part").alias("norm")))


def assign(entities: DataFrame, key: str) -> DataFrame:
    """kind, norm, attempt, new: an attempt for each entity so that replacements
    are distinct within a kind and none is itself an entity."""
    rows = entities.withColumn("attempt", F.lit(0))
    for _ in range(MOST_ATTEMPTS):
        rows = materialize(with_surrogate(rows, key).withColumn("low", F.lower("new")), "pii-entities")
        first = rows.groupBy("kind", "low").agg(F.min("norm").alias("first"), F.count(F.lit(1)).alias("c"))
        taken = rows.select("kind", F.lower("norm").alias("low")).distinct().withColumn("taken", F.lit(True))
        bad = (rows.join(first, ["kind", "low"]).join(taken, ["kind", "low"], "left")
               .where((F.col("c") > 1) & (F.col("norm") != F.col("first")) | F.col("taken").isNotNull()))
        bad = materialize(bad.select("kind", "norm", F.lit(1).alias("more")), "pii-again")
        if bad.limit(1).count() == 0:
            return rows.drop("low")
        rows = (rows.join(bad, ["kind", "norm"], "left")
                .select("kind", "norm", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt")))
    raise RuntimeError("no distinct replacements found")


def render(forms: DataFrame, parts: DataFrame, entities: DataFrame) -> DataFrame:
    """m, out: each mention's replacement in its own format and case."""
    m, kind, new = F.col("m"), F.col("kind"), F.col("new")
    whole = kind.isin("email", "secret")  # separators belong to these
    bare = lambda c: F.when(whole, c).otherwise(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))

    def one(i: Column) -> Column:
        c = F.substr(m, i, F.lit(1))
        after = F.length(bare(F.substr(m, i + 1, F.length(m))))
        r = F.substr(new, F.length(new) - after, F.lit(1))
        return F.when((F.length(bare(c)) == 0) | (after >= F.length(new)), c).when(
            c != F.lower(c), F.upper(r)).otherwise(r)

    # what has grown goes before the first replaced character
    extra = F.substr(new, F.lit(1), F.greatest(F.length(new) - F.when(kind == "phone", F.length("norm")).otherwise(
        F.length(bare(m))), F.lit(0)))
    part = F.col("part")
    word = (F.when(new.isNull(), part).when(part.rlike(r"\.$"), F.concat(F.substr(new, F.lit(1), F.lit(1)), F.lit(".")))
            .when(part == F.upper(part), F.upper(new)).otherwise(new))
    named = (parts.join(entities.select("kind", "norm", "new"), ["kind", "norm"], "left").groupBy("m", "titles")
             .agg(F.array_sort(F.collect_list(F.struct("place", word.alias("word")))).alias("words"))
             .select("m", F.concat("titles", F.array_join(F.col("words.word"), " ")).alias("out")))
    return (forms.join(entities.select("kind", "norm", "new"), ["kind", "norm"])
            .select("m", F.when(kind == "ip", new)
                    .otherwise(F.concat(extra, F.array_join(F.transform(_places(m), one), ""))).alias("out"))
            .unionByName(named))


def replace_entities(docs: DataFrame, key: str = "surrogate-key") -> DataFrame:
    """``docs`` with entities in ``text`` replaced, and ``n_entities``.

    ``key`` is the secret that replacements depend on.  All other columns stay
    as they are.  A null text stays null with 0 entities, an empty text empty;
    ids are not used, so null or repeated ones do no harm, and equal rows get
    equal results.  An empty table gives no rows.  A column already named
    ``n_entities`` is replaced.  Names are found behind a title, with all their
    words up to a day, a month or a sentence's first word; each of these is then
    replaced wherever it stands in the same text.
    """
    mentions = materialize(mention_table(docs), "pii-mentions")
    forms = materialize(normal_forms(mentions), "pii-forms")
    parts = materialize(name_parts(forms), "pii-names")
    entities = forms.where("norm IS NOT NULL").select("kind", "norm").union(
        parts.where("kind IS NOT NULL").select("kind", "norm")).distinct()
    entities = assign(entities, key)
    written = materialize(render(forms, parts, entities), "pii-written")
    of_text = (mentions.join(written, "m").groupBy("text_key")
               .agg(F.map_from_entries(F.collect_list(F.struct("m", "out"))).alias("_out")))
    # a word alone is the surname where the text has it as one
    bare = (mentions.join(parts.where(r"kind IS NOT NULL AND NOT endswith(part, '.')"), "m")
            .join(entities.select("kind", "norm", "new"), ["kind", "norm"]).groupBy("text_key", "norm")
            .agg(F.min(F.struct(F.col("kind") != "surname", "new")).getField("new").alias("new")).groupBy("text_key")
            .agg(F.map_from_entries(F.collect_list(F.struct("norm", "new"))).alias("_bare")))
    of_text = materialize(of_text.join(bare, "text_key", "left").withColumnRenamed("text_key", "_key"), "pii-texts")

    # the caller's columns travel in one struct, so none can meet a name used here
    text = F.col("_text")
    kept = [c for c in docs.columns if c != "n_entities"]
    hinted = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in kept]).alias("_row"),
                         F.col("text").cast("string").alias("_text"))
    hinted = hinted.withColumn("_k", F.when(text.rlike(HINT), F.unhex(F.md5(text.cast("binary")))))
    plain = hinted.where("_k IS NULL").withColumn("n_entities", F.lit(0).cast("long"))
    found = hinted.where("_k IS NOT NULL").join(_broadcast_up_to(of_text), F.col("_k") == F.col("_key"), "left")
    found = found.withColumn("_m", F.when(F.col("_out").isNotNull(), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))))
    found = found.withColumn("_p", F.when(F.col("_out").isNotNull(), F.split(text, PATTERN, -1)))
    of = lambda w: F.try_element_at(F.col("_bare"), F.lower(w))

    def renamed(p: Column) -> Column:
        words = F.regexp_extract_all(p, F.lit(_BARE), F.lit(0))
        put = F.transform(words, lambda w: F.coalesce(F.when(w == F.upper(w), F.upper(of(w))).otherwise(of(w)), w))
        return F.array_join(F.transform(F.split(p, _BARE, -1), lambda x, i: F.concat(
            x, F.coalesce(F.get(put, i), F.lit("")))), "")

    alone = F.aggregate(F.col("_p"), F.lit(0), lambda n, p: n + F.size(F.filter(
        F.regexp_extract_all(p, F.lit(_BARE), F.lit(0)), lambda w: of(w).isNotNull())))
    woven = F.array_join(F.transform(F.col("_p"), lambda p, i: F.concat(
        F.when(F.col("_bare").isNull(), p).otherwise(renamed(p)),
        F.coalesce(F.try_element_at(F.col("_out"), F.get(F.col("_m"), i)), F.lit("")))), "")
    count = F.coalesce(F.greatest(F.size("_m"), F.lit(0)), F.lit(0)) + F.when(F.col("_bare").isNull(), 0).otherwise(alone)
    found = (found.withColumn("n_entities", count.cast("long"))
             .withColumn("_text", F.when(F.col("_m").isNull(), text).otherwise(woven)))
    both = plain.select("_row", "_text", "n_entities").unionByName(found.select("_row", "_text", "n_entities"))
    return both.select(*[(text if c == "text" else F.col("_row").getField(c)).alias(c) for c in kept], "n_entities")


def _broadcast_up_to(of_text: DataFrame, most: int = 64 << 20) -> DataFrame:
    """Marked for broadcast if all its replacements take at most ``most`` bytes as text."""
    size = F.octet_length(F.to_json(F.struct("_out", "_bare"))).cast("long") + 64
    return F.broadcast(of_text) if (of_text.agg(F.sum(size)).first()[0] or 0) <= most else of_text
