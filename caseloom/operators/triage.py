"""Complaint triage: mixed Hindi and English to a case type, its legal context, and petition text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases that stand for English ones.
PHRASES = {
    "kiraya": "rent", "makaan": "house", "ghar": "house", "paisa": "money", "paise": "money", "khet": "crop", "kisan": "farmer", "baadh": "flood", "baarish": "rain",
    "naukri": "job", "kaam": "work", "malik": "employer", "dukaan": "shop", "zameen": "land", "jameen": "land", "police ne nahi ki": "police refused", "police ne nahi": "police refused",
    "fir nahi ki": "fir not filed", "fir nahi": "fir not filed", "nahi diya": "not paid", "nahi mila": "not received", "nahi hua": "not done", "reject ho gaya": "rejected",
    "reject kar diya": "rejected", "tankhwah nahi": "salary unpaid", "tankhwah nahi mili": "salary unpaid", "police ne": "police", "fasal bima": "crop insurance", "bima claim": "insurance claim",
}
#: Case types in order, with their words in English and Hindi, authority and first section.
TYPES = [
    ("fir_refusal", ["fir", "police", "refused", "register", "complaint", "station", "officer", "did not file", "fir nahi", "not registered"], ["एफआईआर", "पुलिस", "रजिस्टर", "शिकायत", "दर्ज", "थाना", "नहीं किया", "दर्ज नहीं"], "Judicial Magistrate First Class", "CrPC 154"),
    ("crop_insurance", ["crop", "insurance", "pmfby", "farmer", "harvest", "kisan", "rejected", "claim", "fasal", "fasal bima", "crop loss"], ["फसल", "बीमा", "पीएमएफबीवाई", "किसान", "दावा", "अस्वीकार", "मुआवजा", "फसल बीमा"], "District Collector / Grievance Portal", "PMFBY Guidelines 2016"),
    ("flood_relief", ["flood", "disaster", "relief", "sdrf", "ndrf", "damage", "house", "compensation", "water", "baadh", "inundated"], ["बाढ़", "आपदा", "राहत", "एसडीआरएफ", "मुआवजा", "नुकसान", "घर", "पानी", "तबाही"], "District Collector / DM Office", "SDRF Guidelines 2015"),
    ("wage_theft", ["salary", "wage", "unpaid", "employer", "work", "payment", "money", "labour", "job", "nahi diya", "dues"], ["तनख्वाह", "वेतन", "नहीं दिया", "मालिक", "काम", "पैसा", "मजदूरी", "बकाया"], "Labour Commissioner Office", "Payment of Wages Act 1936"),
    ("rti_request", ["rti", "information", "government", "document", "right to information", "public", "record", "apply rti"], ["आरटीआई", "सूचना", "जानकारी", "दस्तावेज", "सरकार", "सार्वजनिक", "अधिकार"], "Public Information Officer (PIO)", "Right to Information Act 2005 Section 6"),
    ("consumer_complaint", ["consumer", "product", "defective", "refund", "service", "fraud", "company", "purchased", "cheated", "e-commerce"], ["उपभोक्ता", "सामान", "खराब", "वापसी", "सेवा", "धोखा", "खरीदा", "रिफंड"], "District Consumer Disputes Redressal Commission", "Consumer Protection Act 2019"),
    ("land_dispute", ["land", "property", "encroachment", "zameen", "plot", "boundary", "illegal occupation", "khasra", "deed"], ["जमीन", "संपत्ति", "अतिक्रमण", "ज़मीन", "कब्जा", "बाउंड्री", "खसरा", "मालिकाना"], "Civil Court / Revenue Court", "Transfer of Property Act 1882"),
    ("domestic_violence", ["domestic violence", "husband", "wife", "abuse", "beating", "dowry", "harassment", "498a", "shelter"], ["घरेलू हिंसा", "पति", "पत्नी", "मारपीट", "दहेज", "उत्पीड़न", "प्रताड़ना", "शरण"], "Protection Officer / Magistrate", "Protection of Women from Domestic Violence Act 2005"),
    ("labour_complaint", ["labour", "worker", "factory", "overtime", "minimum wage", "fired", "dismissed", "termination", "unsafe"], ["मजदूर", "श्रमिक", "कारखाना", "ओवरटाइम", "न्यूनतम वेतन", "बर्खास्त", "छंटनी", "असुरक्षित"], "Labour Commissioner / Industrial Tribunal", "Labour Code 2020"),
]


def ordered_phrases() -> list[tuple[str, str]]:
    """Longest first; equal lengths keep their order."""
    return sorted(PHRASES.items(), key=lambda kv: -len(kv[0]))


def translated(text: Column) -> Column:
    out = F.trim(F.lower(text))
    for phrase, word in ordered_phrases():
        out = F.replace(out, F.lit(phrase), F.lit(word))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def classified(df: DataFrame, text: str = "text") -> DataFrame:
    """df with case_type, score, confidence, authority, section, language and the question to ask if unsure.

    A phrase counts 3 and a word 1; the first type wins ties; confidence is score / 5, 1 at most.
    """
    english, hindi = F.col("_english"), F.col("_hindi")
    scores = []
    for name, en, hi, *_ in TYPES:
        hits = [F.when(F.contains(english, F.lit(w)) if " " in w else english.rlike(rf"(?<![\w]){w}(?![\w])"), 3 if " " in w else 1).otherwise(0) for w in en]
        hits += [F.when(F.contains(hindi, F.lit(w)), 3 if " " in w else 1).otherwise(0) for w in hi]
        scores.append(F.aggregate(F.array(*hits), F.lit(0), lambda a, x: a + x))
    out = df.withColumns({"_english": translated(F.col(text)), "_hindi": F.lower(text)}).withColumn("_scores", F.array(*scores))
    best = F.array_max("_scores")
    at = F.array_position("_scores", best).cast("int")
    pick = lambda i, none: F.when(best == 0, F.lit(none)).otherwise(F.element_at(F.array(*[F.lit(t[i]) for t in TYPES]), at))
    letters = F.regexp_count(F.col(text), F.lit("[ऀ-ॿ]"))
    out = out.withColumns({"case_type": pick(0, "unknown"), "score": best, "confidence": F.least(F.lit(1.0), best / 5.0), "authority": pick(3, None), "section": pick(4, None), "language": F.when(letters > 5, "hi").when(letters > 0, "hinglish").otherwise("en")})
    return out.withColumn("question", F.when(F.col("confidence") < 0.6, "Please describe what happened, when and where.")).drop("_english", "_hindi", "_scores")


def filled(template: Column, values: Column, fields: list[str]) -> Column:
    """The template with {field} replaced by the map's value, else by a marker to fill in."""
    for f in fields:
        v = F.nullif(F.element_at(values, F.lit(f)), F.lit(""))
        template = F.replace(template, F.lit("{" + f + "}"), F.coalesce(v, F.lit(f"[{f.upper()} — Please Fill]")))
    return template


def gaps(document: Column) -> Column:
    """The distinct fields that are still to be filled, in order."""
    return F.array_distinct(F.regexp_extract_all(document, F.lit("\\[([A-Z_]+) — Please Fill\\]"), F.lit(1)))


def next_step(round_number: Column, elapsed: Column, n_objections: Column) -> Column:
    """filing at the second round, after 90 seconds or without objections; else back to the advocate."""
    return F.when((round_number >= 2) | (elapsed > 90.0) | (n_objections == 0), "filing").otherwise("advocate")
