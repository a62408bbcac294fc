"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much text is rejected.

All expressions are built-in functions, so that rows never leave the JVM and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import SPACES, replaced, words

SYMBOLS = "#*$%&|<>"
#: What marks a line of navigation and one of boilerplate, in English, German, French and Spanish.
NAVIGATION = r"^\W*(home|menu|login|log in|sign in|sign up|subscribe|next|previous|share|read more|skip to content|back to top|contact us|about us|site map|startseite|anmelden|abmelden|registrieren|abonnieren|weiter|zurück|teilen|weiterlesen|mehr lesen|zum inhalt springen|nach oben|kontakt|über uns|accueil|connexion|se connecter|s'inscrire|s'abonner|suivant|précédent|partager|lire la suite|en savoir plus|aller au contenu|haut de page|contactez-nous|à propos|plan du site|inicio|menú|iniciar sesión|registrarse|suscribirse|siguiente|anterior|compartir|leer más|ir al contenido|volver arriba|contacto|sobre nosotros|mapa del sitio)(?:$|[^\w].{0,20}$)"
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "licensed under the", "copyright (c)",
    "alle rechte vorbehalten", "cookie-richtlinie", "datenschutzerklärung", "nutzungsbedingungen", "javascript aktivieren",
    "tous droits réservés", "politique de confidentialité", "politique de cookies", "conditions d'utilisation", "activer javascript",
    "todos los derechos reservados", "política de privacidad", "política de cookies", "condiciones de uso", "active javascript",
)
#: A line ends with one of these; a line of LONG words or more may have its end mark anywhere, as when its end was cut off.
END = r"[.!?:;\")\]»…。！？：；」』）]\s*$"
END_WITHIN = r"[.!?…](\s|$)|[。！？]"
LONG = 10
#: A window's place and hash share a long: bits for the place, the rest for the hash. Longer texts are sorted as pairs with whole hashes;
#: either way one text in some 1e9 has two windows that differ and are held to be equal.
PLACE_BITS = 11


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(replaced(text, chars))


def line_fails(line: Column, n_words: Column, symbols: Column, bangs: Column, terms: Column) -> Column:
    """Whether a line breaks a punctuation, navigation or boilerplate rule.

    n_words: the line's own. symbols, bangs, terms: whether the whole text holds any symbol, exclamation mark or boilerplate term;
    where it doesn't, its lines need no look.
    """
    chars = F.length(line)
    unfinished = ~line.rlike(END) & ((n_words < LONG) | ~line.rlike(END_WITHIN))
    shouting = (chars >= 20) & ~line.rlike("[a-z]") & line.rlike("[A-Z]")
    boilerplate = F.lit(False)
    for term in BOILERPLATE:
        boilerplate = boilerplate | F.lower(line).contains(term)
    return (
        unfinished
        | (symbols & ((10 * _count(line, SYMBOLS) > chars) | ((_count(line, "|") >= 2) & (3 * _count(line, "|") >= n_words))))
        | shouting
        | (bangs & (chars >= 20) & (20 * _count(line, "!") > chars))
        | ((chars < 60) & line.rlike("(?iu)" + NAVIGATION))
        | (terms & boilerplate)
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and _counted, an array of the lines that have a word (struct line, n).

    n_repeat_words: words in 3-word windows found twice or more in the text. Windows are compared by hash, sorted with their
    places; the cost is n log n in a text's length and nothing leaves the row.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_split", F.filter(F.transform(F.split(body, "\n", -1), lambda x: F.struct(x.alias("line"), words(x).alias("w"))), lambda e: F.size(e["w"]) > 0))
    out = out.withColumns({
        "_counted": F.transform("_split", lambda e: F.struct(e["line"].alias("line"), F.size(e["w"]).alias("n"))),
        "_hash": F.flatten(F.transform("_split", lambda e: F.transform(e["w"], lambda w: F.xxhash64(w)))),
    })
    n = F.size("_hash")
    cut = lambda k: F.slice("_hash", k, F.greatest(n - 2, F.lit(0)))
    out = out.withColumn("_window", F.zip_with(F.zip_with(cut(1), cut(2), lambda a, b: F.xxhash64(a, b)), cut(3), lambda a, b: F.xxhash64(a, b)))
    some = F.size(F.array_distinct("_window")) < F.size("_window")
    out = out.withColumns({
        "_packed": F.when(some & (n < 1 << PLACE_BITS), F.sort_array(F.transform("_window", lambda h, i: F.shiftleft(h, PLACE_BITS).bitwiseOR(i.cast("long"))))),
        "_pairs": F.when(some & (n >= 1 << PLACE_BITS), F.sort_array(F.transform("_window", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    })

    def again(name: str, same, place) -> Column:
        """Sorted places of the windows that equal a neighbour in sorted order."""
        m = F.size(name) - 1
        near = F.zip_with(F.slice(name, 1, m), F.slice(name, 2, m), lambda a, b: F.when(same(a, b), F.array(place(a), place(b))))
        return F.sort_array(F.array_distinct(F.flatten(F.array_compact(near))))

    out = out.withColumn(
        "_again",
        F.when(F.col("_packed").isNotNull(), again("_packed", lambda a, b: F.shiftright(a.bitwiseXOR(b), PLACE_BITS) == 0, lambda a: a.bitwiseAND((1 << PLACE_BITS) - 1).cast("int")))
        .when(F.col("_pairs").isNotNull(), again("_pairs", lambda a, b: a["h"] == b["h"], lambda a: a["i"])),
    )
    k = F.size("_again")
    gaps = F.zip_with(F.slice("_again", 1, k - 1), F.slice("_again", 2, k - 1), lambda a, b: F.least(b - a, F.lit(3)))
    return out.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(replaced(body, SPACES)).cast("long"),
        "n_symbols": _count(body, SYMBOLS).cast("long"),
        "n_dup_lines": (F.size("_counted") - F.size(F.array_distinct(F.transform("_counted", lambda e: e["line"])))).cast("long"),
        "n_repeat_words": F.when(k > 0, F.aggregate(gaps, F.lit(3), lambda a, x: a + x)).otherwise(0).cast("long"),
    }).drop("_split", "_hash", "_window", "_packed", "_pairs", "_again")


#: Columns that clean_lines adds.
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_words", "kept", "clean_text")


def clean_lines(docs: DataFrame, text: str = "text", max_lost: int = 50, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """Line-first cleaning of every document.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_words (in failing lines and in repeats
    of an earlier line), kept, and clean_text (the lines that stay, in order). kept: the base rules hold and lost_words is at
    most max_lost hundredths of n_words.

    Null text counts as empty: all counts are 0, base_failed is true, kept false, clean_text empty. Rows are never dropped;
    repeated rows, null ids and an empty table pass through. Columns of the input that bear one of the added names, or start with
    an underscore, are not passed on.
    """
    out = measure(docs.select(*[c for c in docs.columns if c not in ADDED and not c.startswith("_")]), text)
    body = F.coalesce(F.col(text), F.lit(""))
    out = out.withColumn("_low", F.lower(body))  # a column of its own, so that it is computed once, not for each term
    terms = F.lit(False)
    for term in BOILERPLATE:
        terms = terms | F.col("_low").contains(term)
    # one number, used three times: the optimizer then keeps it out of the lambda, where it would be computed anew for each line
    out = out.withColumn("_flags", F.when(F.col("n_symbols") > 0, 1).otherwise(0) + F.when(body.contains("!"), 2).otherwise(0) + F.when(terms, 4).otherwise(0))
    flag = lambda bit: F.col("_flags").bitwiseAND(bit) > 0
    out = out.withColumn("_good", F.filter("_counted", lambda e: ~line_fails(e["line"], e["n"], flag(1), flag(2), flag(4))))
    out = out.withColumn("_lines", F.array_distinct(F.transform("_good", lambda e: e["line"])))
    left = F.when(F.size("_lines") == F.size("_good"), F.aggregate("_good", F.lit(0), lambda a, e: a + e["n"])).otherwise(F.aggregate("_lines", F.lit(0), lambda a, x: a + F.size(words(x))))
    out = out.withColumns({
        "lost_words": (F.col("n_words") - left).cast("long"),
        "base_failed": (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")),
        "clean_text": F.array_join("_lines", "\n"),
    })
    out = out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_words") <= max_lost * F.col("n_words")))
    return out.drop("_counted", "_good", "_lines", "_flags", "_low")
