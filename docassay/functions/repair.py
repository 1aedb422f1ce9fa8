"""Repair of pages whose labels and values were taken for one another, as a fold over a page's strings.

A page is the map of what the extractor paired, and the list of texts that it could not pair. What can be said of
a text by itself (label, heading, name, number, code) and of what follows it (the next text that is no label, the next
that says a sex) is worked out once for each; then a finite state, the fields found so far, is carried over them:

1. pairs: a key with a label's keyword gives its value to that field; a key shaped like a permit number, or a name
   whose value is a label, is data itself; a number of up to four digits is part of a date; other pairs stay;
2. unpaired texts, in order: a label takes the next text that is no label, lone codes, sexes, years and names
   fill fields that nobody has;
3. names that stood as keys fill surname and given name;
4. dates are put together from years and numbers.

Cases. Null maps and lists are empty. Blank texts are left out. A page without anything to repair gives its pairs back
under lower-case keys. Digits are ASCII. A page is one row; its work grows with the square of its texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay.functions.adapt import ALPHA3, NOISE, clean_value, is_name_token, label_keyword, let, looks_like_permit_number

#: Fields that texts can fill.
SLOTS = ("permit_number", "id_number", "surname", "given_name", "nationality", "issuing_country", "gender", "date_of_birth", "date_of_expiry", "permit_type", "address")
# Labels that stand for surname and given name at once.
BOTH_NAMES = ("PEREKONNANIMI", "SURNAME FORENAME", "SURNAME GIVEN", "NOM PRENOM", "APELLIDO NOMBRE", "NACHNAME VORNAME")
# Sexes as cards print them; codes that are no state; how a permit's type begins and goes on.
SEXES = ("M", "F", "N", "X")
NO_STATES = ("EU", "EC", "UN", "ID", "OK", "PC", "DC")
NO_NATIONS = ("EU", "EC", "UN")
TYPE_HEADS = ("PIKAAJALINE", "LONG")
TYPE_WORDS = ("ELANIK", "RESIDENT", "TERM", "EU", "EC", "PIKAAJALINE", "LONG", "TEMPORARY")
EXPIRY_KEYS = ("kehtiv", "expiry", "valid")

STATE = "struct<%s, skip:int, surname_seen:boolean, given_seen:boolean, expiry_year:string, birth_year:string, numbers:array<string>, names:array<string>>" % ", ".join(f"{s}:string" for s in SLOTS)


def _any(texts: tuple[str, ...], c: Column) -> Column:
    return c.rlike("|".join(texts))


def _none() -> Column:
    return F.lit(None).cast("string")


def read_pairs(fields: Column) -> Column:
    """What each pair says: name and value of a field (``keeps``: an earlier value stays), or a name, or part of a date."""

    def read(e: Column) -> Column:
        key, low, value = F.trim(e["key"]), F.lower(F.trim(e["key"])), clean_value(e["value"])
        return let(F.struct(key.alias("key"), low.alias("low"), value.alias("value"), label_keyword(key)[1].alias("label")), said)

    def said(f: Column) -> Column:
        key, low, value, label = f["key"], f["low"], f["value"], f["label"]
        noise = F.upper(value).isin(*NOISE) | label_keyword(value)[0].isNotNull()
        kind = (
            F.when(label.isNotNull() & value.isNotNull(), "label")
            .when(label.isNull() & looks_like_permit_number(key), "permit")
            .when(is_name_token(key) & F.coalesce(noise, F.lit(False)), "name")
            .when(key.rlike(r"^[0-9]{1,4}$"), "date")
            .when(value.isNotNull(), "plain")
        )
        name = F.when(kind == "label", label).when(kind == "permit", "permit_number").when(kind == "plain", low)
        return F.struct(kind.alias("kind"), name.alias("name"), F.when(kind == "permit", F.upper(key)).otherwise(value).alias("value"), key.alias("key"))

    return F.filter(F.transform(F.map_entries(fields), read), lambda p: p["kind"].isNotNull())


def _settled(pairs: Column, name: Column) -> Column:
    """The value of a field after all pairs: of plain pairs the last, else the first."""
    own = F.filter(pairs, lambda p: p["name"] == name)
    plain = F.filter(own, lambda p: p["kind"] == "plain")
    return F.coalesce(F.try_element_at(plain, F.lit(-1)), F.try_element_at(own, F.lit(1)))["value"]


def read_texts(texts: Column) -> Column:
    """Each unpaired text with what it is, ``then``: the place of the next text that is no label, and ``sex``: the sex that follows it before a label does."""

    def read(t: Column) -> Column:
        return F.struct(t.alias("text"), F.upper(t).alias("upper"), label_keyword(t)[1].alias("label"))

    def judge(f: Column) -> Column:
        t, u = f["text"], f["upper"]
        return F.struct(t.alias("text"), u.alias("upper"), f["label"].alias("label"), (u.isin(*NOISE) | f["label"].isNotNull()).alias("noise"), is_name_token(t).alias("name"), is_name_token(u).alias("upper_name"))

    bare = F.filter(F.transform(texts, lambda t: F.btrim(t, F.lit(" \t\n\r\x0b\x0c"))), lambda t: t.isNotNull() & (t != ""))
    judged = F.transform(F.transform(bare, read), judge)

    def placed(all_: Column) -> Column:
        size = F.size(all_)
        values = F.filter(F.transform(all_, lambda f, i: F.when(~f["noise"], i)), lambda i: i.isNotNull())
        ends = F.filter(F.transform(all_, lambda f, i: F.when(f["upper"].isin(*SEXES) | f["label"].isNotNull(), i)), lambda i: i.isNotNull())
        after = lambda i: F.coalesce(F.array_min(F.filter(values, lambda k: k > i)), size)

        def place(f: Column, i: Column) -> Column:
            then = after(i)
            end = F.array_min(F.filter(ends, lambda k: k >= then))
            sex = let(F.get(all_, end)["upper"], lambda u: F.when(u.isin(*SEXES), u))
            run = F.array_min(F.filter(F.sequence(i + 1, F.greatest(size, i + 1)), lambda k: ~F.coalesce(F.get(all_, k)["upper"].isin(*TYPE_WORDS), F.lit(False))))
            return F.struct(f["text"].alias("text"), f["upper"].alias("upper"), f["label"].alias("label"), f["name"].alias("name"), f["upper_name"].alias("upper_name"), i.alias("at"), then.alias("then"), F.when(f["label"] == "gender", sex).alias("sex"), F.when(f["upper"].isin(*TYPE_HEADS), run).alias("run"))

        return F.transform(all_, place)

    return let(judged, placed)


def _event(state: Column, f: Column, texts: Column) -> Column:
    """What a text does: the slot it fills with a value, what it adds to numbers or names, where reading goes on."""
    u, t, label = f["upper"], f["text"], f["label"]
    free = lambda slot: state[slot].isNull()
    candidate = F.get(texts, f["then"])["text"]
    by_label = (
        F.when(label.isin("permit_number", "id_number", "surname", "given_name", "permit_type", "address"), candidate)
        .when((label == "nationality") & F.length(candidate).isin(2, 3) & ~F.upper(candidate).isin(*NO_NATIONS), candidate)
        .when(label == "gender", f["sex"])
        .when(label.isin("date_of_expiry", "date_of_birth") & candidate.rlike("[0-9]{4}"), candidate)
    )
    taken = F.coalesce(*[F.when(label == s, state[s]) for s in SLOTS])
    both = _any(BOTH_NAMES, u)
    states = sorted({*ALPHA3.values()})
    kind = (
        F.when(f["at"] < state["skip"], "none")
        .when(both, "both")
        .when(label.isNotNull(), F.when(taken.isNull(), "label").otherwise("none"))
        .when(u.isin(*[c for c in ALPHA3 if c != "EST"]) & free("nationality"), "nationality")
        .when(u.isin(*[c for c in states if c not in NO_STATES]) & free("issuing_country"), "issuing_country")
        .when(u.isin(*SEXES) & free("gender"), "gender")
        .when(t.rlike(r"^[NMFXnmfx]\s*/\s*[MFHKmfhk]$"), F.when(free("gender"), "gender").otherwise("none"))
        .when(u.isin(*TYPE_HEADS) & free("permit_type"), "permit_type")
        .when(t.rlike("^[0-9]{4}$"), F.when(free("date_of_expiry"), "expiry_year").when(free("date_of_birth"), "birth_year").otherwise("none"))
        .when(t.rlike("^[0-9]{2}$"), "number")
        .when(f["upper_name"], F.when(free("surname") & ~state["surname_seen"], "surname").when(free("given_name") & ~state["given_seen"], "given_name").when(F.size(state["names"]) == 0, "names").otherwise("none"))
        .when(t.rlike("^[A-Z][a-z]+$") & free("surname"), "capital")
        .otherwise("none")
    )

    def full(k: Column) -> Column:
        words = F.transform(F.slice(texts, f["at"] + 1, F.greatest(f["run"] - f["at"], F.lit(0))), lambda x: x["upper"])
        value = F.when(k == "label", by_label).when(k.isin("nationality", "issuing_country", "gender", "capital"), u).when(k == "permit_type", F.array_join(words, " ")).otherwise(t)
        slot = F.when(k == "label", label).when(k == "capital", "surname").otherwise(k)
        return F.struct(k.alias("kind"), slot.alias("slot"), value.alias("value"), F.when(k == "both", _two_names(f, texts)).alias("two"))

    return let(kind, full)


def _two_names(f: Column, texts: Column) -> Column:
    """Surname and given name behind a label of both, and where reading goes on."""
    first = F.get(texts, f["then"])

    def rest(one: Column) -> Column:
        at = F.when(one["name"], one["then"]).otherwise(f["then"])
        second = F.get(texts, at)
        return F.struct(F.when(one["name"], one["text"]).alias("surname"), F.when(F.coalesce(one["name"], F.lit(False)) & F.coalesce(second["name"], F.lit(False)), second["text"]).alias("given_name"), F.greatest(f["at"] + 1, F.coalesce(at, f["then"])).alias("skip"))

    return let(first, rest)


def _step(state: Column, f: Column, texts: Column) -> Column:
    def apply(e: Column) -> Column:
        kind, value, two = e["kind"], e["value"], e["two"]
        slots = [F.coalesce(state[s], *([two[s]] if s in ("surname", "given_name") else []), F.when(e["slot"] == s, value)).alias(s) for s in SLOTS]
        return F.struct(
            *slots,
            F.when(kind == "both", two["skip"]).when(kind == "permit_type", f["run"]).otherwise(state["skip"]).alias("skip"),
            (state["surname_seen"] | kind.isin("surname", "capital") | two["surname"].isNotNull()).alias("surname_seen"),
            (state["given_seen"] | (kind == "given_name") | two["given_name"].isNotNull()).alias("given_seen"),
            F.coalesce(state["expiry_year"], F.when(kind == "expiry_year", value)).alias("expiry_year"),
            F.coalesce(state["birth_year"], F.when(kind == "birth_year", value)).alias("birth_year"),
            F.when(kind == "number", F.array_append(state["numbers"], value)).otherwise(state["numbers"]).alias("numbers"),
            F.when(kind == "names", F.array_append(state["names"], value)).otherwise(state["names"]).alias("names"),
        ).cast(STATE)

    return let(_event(state, f, texts), apply)


def _fold_texts(pairs: Column, texts: Column) -> Column:
    none = F.array().cast("array<string>")
    names = F.transform(F.filter(pairs, lambda p: p["kind"] == "name"), lambda p: p["key"])
    start = F.struct(*[_settled(pairs, F.lit(s)).alias(s) for s in SLOTS], F.lit(0).alias("skip"), F.lit(False).alias("surname_seen"), F.lit(False).alias("given_seen"), _none().alias("expiry_year"), _none().alias("birth_year"), none.alias("numbers"), names.alias("names"))
    return F.aggregate(texts, start.cast(STATE), lambda s, f: _step(s, f, texts))


def _names(state: Column) -> Column:
    """Names that stood as keys, where surname and given name are still open."""
    start = F.struct(state["surname"].alias("surname"), state["given_name"].alias("given_name"))

    def put(s: Column, name: Column) -> Column:
        n = F.upper(name)
        given = F.when(s["surname"].isNotNull() & (F.upper(s["surname"]) != n), n)
        return F.struct(F.coalesce(s["surname"], n).alias("surname"), F.coalesce(s["given_name"], given).alias("given_name"))

    return F.aggregate(state["names"], start, put)


def _dates(state: Column, pairs: Column, fields: Column) -> Column:
    """struct(date_of_birth, date_of_expiry) from whole dates, years and numbers."""
    pad = lambda n: F.lpad(n.cast("int").cast("string"), F.greatest(F.length(n.cast("int").cast("string")), F.lit(2)), F.lit("0"))
    iso = lambda y, m, d: F.concat_ws("-", y, pad(m), pad(d))
    part = F.try_element_at(F.filter(pairs, lambda p: (p["kind"] == "date") & p["value"].rlike("^[0-9]{4}$")), F.lit(1))
    used = part.isNotNull() & state["date_of_birth"].isNull() & state["birth_year"].isNull()
    known = F.struct(F.when(used, part["value"]).otherwise(state["birth_year"]).alias("year"), F.when(used, F.array_append(state["numbers"], part["key"])).otherwise(state["numbers"]).alias("numbers"))

    def born(k: Column) -> Column:
        n = k["numbers"]
        made = F.when(k["year"].isNotNull() & (F.size(n) >= 2), iso(k["year"], F.get(n, F.lit(1)), F.get(n, F.lit(0))))
        return F.struct(F.coalesce(state["date_of_birth"], made).alias("birth"), n.alias("numbers"))

    def expires(b: Column) -> Column:
        year = F.coalesce(state["expiry_year"], F.when(F.length(state["date_of_expiry"]) == 4, state["date_of_expiry"]))
        left = F.filter(b["numbers"], lambda n: ~F.coalesce(F.array_contains(F.split(b["birth"], "-"), n), F.lit(False)))
        one, two = F.get(left, F.lit(0)), F.get(left, F.lit(1))
        swapped = (two.cast("int") > 12) & (one.cast("int") <= 12)
        made = F.when(F.size(left) >= 2, F.when(swapped, iso(year, one, two)).otherwise(iso(year, two, one))).otherwise(year)
        late = F.filter(F.map_entries(fields), lambda e: _any(EXPIRY_KEYS, F.lower(e["key"])) & e["value"].rlike("[0-9]{4}"))
        held = F.when(year.isNotNull(), made).otherwise(state["date_of_expiry"])
        return F.struct(b["birth"].alias("date_of_birth"), F.coalesce(held, clean_value(F.get(late, F.lit(0))["value"])).alias("date_of_expiry"))

    return let(let(known, born), expires)


def repair_layout(df: DataFrame, fields: str = "fields", unpaired: str = "unpaired", result: str = "repaired") -> DataFrame:
    """``df`` with a map of repaired fields: those of pairs in their order, then what was found besides."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    map_ = F.coalesce(F.col(fields), empty)
    read = df.withColumn("_pairs", read_pairs(map_)).withColumn("_texts", read_texts(F.coalesce(F.col(unpaired), F.array().cast("array<string>"))))
    read = read.withColumn("_state", _fold_texts(F.col("_pairs"), F.col("_texts")))
    read = read.withColumn("_names", _names(F.col("_state"))).withColumn("_dates", _dates(F.col("_state"), F.col("_pairs"), map_))
    held = {s: F.col("_names")[s] if s in ("surname", "given_name") else F.col("_dates")[s] if s.startswith("date") else F.col("_state")[s] for s in SLOTS}
    pairs = F.col("_pairs")
    first = F.filter(F.array_distinct(F.transform(pairs, lambda p: p["name"])), lambda n: n.isNotNull())
    value = lambda n: F.coalesce(*[F.when(n == s, v) for s, v in held.items()], _settled(pairs, n))
    from_pairs = F.transform(first, lambda n: F.struct(n.alias("key"), value(n).alias("value")))
    found = F.filter(F.array(*[F.struct(F.lit(s).alias("key"), v.alias("value")) for s, v in held.items()]), lambda e: e["value"].isNotNull() & ~F.array_contains(first, e["key"]))
    return read.withColumn(result, F.map_from_entries(F.concat(from_pairs, found))).drop("_pairs", "_texts", "_state", "_names", "_dates")
