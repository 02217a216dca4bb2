"""Text that reports show: annotation comments, safe summaries, file names, clipboard, italics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quoin.functions.text import mapped, strip

# Labels, pictograms and replacements.
CATEGORY_UPPER = {"A": "ORTHOGRAPHE", "B": "GRAMMAIRE", "C": "TYPOGRAPHIE", "D": "SYNTAXE & STYLE", "E": "SÉMANTIQUE", "F": "UNIFORMISATION", "G": "RENVOIS", "H": "VÉRIFICATION DES FAITS"}
PICTOS = {"Certain": "✅", "Probable": "🔶", "À vérifier": "⚠️"}
REPLACEMENTS = [("…", "..."), ("’", "'"), ("‘", "'"), ("“", '"'), ("”", '"'), ("«", "<<"), ("»", ">>"), ("—", "--"), ("–", "-"), ("·", "."), (" ", " "), (" ", " "), ("æ", "ae"), ("œ", "oe"), ("Æ", "AE"), ("Œ", "OE")]
ACCENTS = ("éèêëàâôûùîïçÉÈÊÀ", "eeeeaaouuiicEEEA")
PRESET_LABELS = {"complete": "correction-complete", "quick": "correction-rapide", "coherence": "coherence-globale", "facts": "verification-faits"}


def quoted(c: Column, none: str) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit("« "), c, F.lit(" »"))).otherwise(none)


def comment(mode: str = "detailed") -> Column:
    cat, desc, expl, source = F.col("category"), F.col("description"), F.col("explanation"), F.coalesce("source", F.lit(""))
    form = quoted(F.col("corrected_text"), "à confirmer")
    shown = quoted(F.col("corrected_text"), "—")
    label = F.concat(F.coalesce(mapped(CATEGORY_UPPER, cat), cat), F.lit(" → "), desc)
    if mode == "simple":
        fact = F.concat(F.lit("⚠️ VÉRIFICATION SUGGÉRÉE\n"), desc, F.lit("\nForme possible : "), form)
        return F.when(cat == "H", fact).otherwise(F.concat(label, F.lit("\nCorrection : "), shown))
    fact = F.concat(
        F.lit("⚠️ VÉRIFICATION SUGGÉRÉE PAR L'IA\n\nMotif : "), desc, F.lit("\n\nExplication : "), expl, F.lit("\n\nForme possible : "), form, F.lit("\n\n→ À valider par l'éditeur ou l'auteur avant toute correction."),
        F.when(source != "", F.concat(F.lit("\n\nSource consultée : "), source)).otherwise(""),
    )
    picto = F.coalesce(mapped(PICTOS, F.col("confidence")), F.lit("⚠️"))
    plain = F.concat(label, F.lit("\n"), picto, F.lit(" "), F.col("confidence"), F.lit("\n\nExplication : "), expl, F.lit("\n\nCorrection proposée : "), shown, F.when(source != "", F.concat(F.lit("\n\n"), source)).otherwise(""))
    return F.when(cat == "H", fact).otherwise(plain)


def ascii_safe(c: Column, most: int = 35) -> Column:
    out = F.regexp_replace(c, r"[\n\r]", " ")
    for src, dst in REPLACEMENTS:
        out = F.replace(out, F.lit(src), F.lit(dst))
    out = F.regexp_replace(F.translate(out, *ACCENTS), r"[^\x00-\x7F]", "?")
    out = strip(F.regexp_replace(out, " {2,}", " "))
    return F.when(F.length(out) > most, F.concat(F.substring(out, 1, most), F.lit("..."))).otherwise(out)


def output_name(filename: Column, preset: Column) -> Column:
    stem = F.regexp_replace(F.regexp_replace(filename, r"\.[^.]+$", ""), r"[^A-Za-z0-9._-]", "_")
    return F.concat(F.when(stem == "", "document").otherwise(stem), F.lit("_"), F.coalesce(mapped(PRESET_LABELS, preset), F.lit("correction")), F.lit(".pdf"))


def count_line(n: Column) -> Column:
    s = F.when(n > 1, "s").otherwise("")
    return F.concat(n.cast("string"), F.lit(" correction"), s, F.lit(" annotée"), s)


def clipboard() -> Column:
    head = F.concat(F.lit("p."), (F.col("page_number") + 1).cast("string"), F.lit(" — "), F.col("category"), F.lit(" → "), F.col("description"))
    last = F.when(F.coalesce("corrected_text", F.lit("")) != "", F.concat(F.lit("Correction : « "), F.col("original_text"), F.lit(" » → « "), F.col("corrected_text"), F.lit(" »"))).otherwise(F.concat(F.lit("Texte : « "), F.col("original_text"), F.lit(" »")))
    return F.concat_ws("\n", head, F.nullif(F.col("explanation"), F.lit("")), last)


def without_italics(c: Column | str) -> Column:
    return F.regexp_replace(c, r"\*([^*]+)\*", "$1")


def italics(c: str) -> Column:
    """The passages that a text marks as italic."""
    return F.regexp_extract_all(c, F.lit(r"\*([^*]+)\*"), F.lit(1))


def metadata_block(author: Column, title: Column) -> Column:
    parts = F.concat_ws(
        "\n",
        F.when(author != "", F.concat(F.lit("- Auteur : "), author, F.lit(" — NE JAMAIS signaler comme faute"))),
        F.when(title != "", F.concat(F.lit("- Titre de l'œuvre : "), title, F.lit(" — NE JAMAIS signaler comme faute ou erreur grammaticale"))),
    )
    return F.when(parts != "", F.concat(F.lit("**MÉTADONNÉES (exclusions absolues) :**\n"), parts))


def shown_page(page: Column, total: Column, annotated: Column) -> Column:
    """A preview page kept inside the document; an annotated one ends with a summary page that is not shown."""
    return F.greatest(F.lit(0), F.least(page, total - F.when(annotated, 2).otherwise(1)))


def admitted(filename: Column, head: Column, size: Column) -> Column:
    """Why an upload is refused, or null."""
    return F.when(~F.lower(filename).endswith(".pdf"), "extension").when(~F.startswith(head, F.lit("%PDF")), "magic").when(size > 50 * 1024 * 1024, "size")
