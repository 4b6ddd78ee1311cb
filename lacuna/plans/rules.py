"""Rule packs as tables: what happens to a type of mention, and on which basis."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_FEDERAL_SOURCE = "https://www.bger.ch/files/live/sites/bger/files/pdf/Reglemente/Anonymisierungsregeln_2020_def_d.pdf"
_ZURICH_SOURCE = (
    "https://www.zh.ch/content/dam/zhweb/bilder-dokumente/themen/politik-staat/gesetze-beschluesse/"
    "zhentscheide_anleitung_zum_einreichen_der_zu_publizierenden_entscheide_06.03.2025.pdf"
)

#: Title, adopted, source, placeholder, removed, person letters, place letters.
PACKS = {
    "bger-2020": (
        "Bundesgericht: Regeln für die Anonymisierung der Urteile", "Präsidentenkonferenz 17.12.2019, Verwaltungskommission 13.02.2020",
        _FEDERAL_SOURCE, "{letter}.________", "[…]", "ABCDEFGHIJKLMNOPQRST", "UVWXYZ",
    ),
    "zh-entscheide-2025": (
        "Kanton Zürich, Staatskanzlei: «ZHEntscheide» Anleitung zum Einreichen der zu publizierenden Entscheide", "Stand März 2025",
        _ZURICH_SOURCE, "{letter}.", "[…]", "ABCDEFGHIJKLMNOPQRST", "UVWXYZ",
    ),
}

#: Type, action, basis, why; the action and basis in social insurance matters where they differ.
RULES = {
    "bger-2020": (
        ("private_person", "pseudonymize", "Art. 1 Abs. 1", "Persönlichkeitsrechte der am Verfahren beteiligten natürlichen Privatpersonen"),
        ("private_company", "pseudonymize", "Art. 1 Abs. 1", "Persönlichkeitsrechte der beteiligten juristischen Privatpersonen; Rechtsform bleibt stehen"),
        ("residence", "pseudonymize", "Art. 7 Abs. 1", "Wohnort oder Sitz einer Partei, auch als Gemeindename im Sachverhalt oder in den Erwägungen"),
        ("address", "remove", "Art. 7 Abs. 3", "Adressen von Parteien, Verfahrensbeteiligten und Rechtsvertretern werden in jedem Fall gestrichen"),
        ("authority_address", "keep", "Art. 7 Abs. 3", "Adressen von Behörden sind vorbehalten"),
        ("identifier", "remove", "Art. 1 Abs. 1-2", "Direkte Identifikatoren (AHV-Nr., IBAN, Telefon, E-Mail, Kontrollschild) ermöglichen Zufallsfunde"),
        ("parcel_number", "keep", "keine Regel", "Die Regeln erwähnen Grundstücknummern nicht; das Audit markiert sie als indirekten Identifikator"),
        ("lawyer", "keep", "Art. 4 Abs. 1 lit. g", "Namen der Rechtsvertreter der Parteien"),
        ("court_official", "keep", "Art. 5 Abs. 1", "Behördenmitglieder, Gerichtspersonen, Schiedsrichter, Staatsanwälte"),
        ("authority", "keep", "Art. 4 Abs. 1 lit. a", "Namen von Behörden, öffentlichrechtlichen Anstalten und Körperschaften"),
        ("public_body", "keep", "Art. 4 Abs. 1 lit. a-b", "Öffentlichrechtliche Körperschaften und Gemeindenamen"),
        ("expert", "keep", "Art. 6 Abs. 1", "Behördlich bestellte Experten", "pseudonymize", "Art. 6 Abs. 2"),
        ("place", "keep", "Art. 4 Abs. 1 lit. b, e", "Gemeindenamen und Ortsbezeichnungen, soweit nicht Wohnort oder Sitz einer Partei"),
        ("occupation", "keep", "keine Regel", "Die Regeln verlangen keine Entfernung; das Audit markiert Berufe privater Personen"),
        ("birth_date", "keep", "keine Regel", 'Die Regeln verlangen keine Entfernung; die Praxis nennt den Jahrgang ("Der 1963 geborene A.")'),
    ),
    "zh-entscheide-2025": (
        ("private_person", "pseudonymize", "A.II.1", "Personennamen werden durch einen Buchstaben dargestellt"),
        ("private_company", "pseudonymize", "A.II.1", "Firmen durch einen Buchstaben, unter Belassung der abgekürzten Gesellschaftsform"),
        ("public_body", "pseudonymize", "A.I.2, A.II.5 lit. a", "Gemeinden, Zweckverbände und Anstalten werden anonymisiert, wenn sie verfahrensbeteiligt sind"),
        ("authority", "keep", "A.I.3", "Direktionen, Bezirksbehörden und Verwaltungseinheiten ohne Rechtspersönlichkeit werden genannt"),
        ("lawyer", "pseudonymize", "A.I.4", "Namen anderer im Entscheid genannter Personen"),
        ("court_official", "pseudonymize", "A.I.4", "Namen anderer im Entscheid genannter Personen"),
        ("expert", "pseudonymize", "A.I.4", "Namen anderer im Entscheid genannter Personen oder Institutionen"),
        ("residence", "pseudonymize", "A.II.5 lit. b", "Ortsbezeichnungen, die auf eine beteiligte Person schliessen lassen"),
        ("place", "keep", "A.II.5", "Ortsbezeichnungen werden in der Regel nicht anonymisiert"),
        ("address", "remove", "A.I.4", "Personenbezogene Angaben werden entfernt"),
        ("authority_address", "keep", "A.I.3", "Verwaltungseinheiten werden mit vollständigem Namen genannt"),
        ("identifier", "remove", "A.II.4", "Identifikationsnummern (Fahrzeugkennzeichen, Versichertennummern) werden entfernt"),
        ("parcel_number", "remove", "A.II.4", "Katasternummern werden entfernt"),
        ("occupation", "remove", "A.II.2", "Berufsbezeichnungen werden grundsätzlich entfernt"),
        ("birth_date", "remove", "A.II.3", "Geburtsdaten und Jahrgänge werden entfernt, soweit nicht entscheidwesentlich"),
    ),
}

_KEYS = ("title", "adopted", "source", "placeholder", "removed", "person_letters", "place_letters")


def load_pack(pack: str | Path) -> dict:
    """A pack by name, or from a TOML file with the same keys and a table ``category.<type>`` for each type."""
    if pack in PACKS:
        rules = [(*r, None, None)[:6] for r in RULES[pack]]
        return dict(zip(_KEYS, PACKS[pack], strict=True)) | {"id": pack, "rules": rules}
    path = Path(pack)
    if path.suffix != ".toml" or not path.exists():
        raise KeyError(f"unknown rule pack: {pack}")
    data = tomllib.loads(path.read_text())
    rules = [(t, c["action"], c["basis"], c["why"], c.get("social_insurance_action"), c.get("social_insurance_basis")) for t, c in data["category"].items()]
    return {k: data.get(k, "") for k in ("id", *_KEYS)} | {"rules": rules}


def available_packs(folder: str | Path | None = None) -> list[str]:
    """The names of the packs that come with the package, or of the TOML packs in a folder, sorted."""
    return sorted(PACKS) if folder is None else sorted(p.stem for p in Path(folder).glob("*.toml"))


def rule_table(spark: SparkSession, pack: dict) -> DataFrame:
    """type, action, basis, why, si_action, si_basis: a table of a fixed few rows."""
    return spark.createDataFrame(pack["rules"], "type string, action string, basis string, why string, si_action string, si_basis string")


def letters(first: str, avoid: str) -> list[str]:
    """The pack's letters, then those of A to Z that neither list has, then AA to ZZ."""
    alphabet = [chr(c) for c in range(ord("A"), ord("Z") + 1)]
    rest = [c for c in alphabet if c not in first and c not in avoid]
    return [*first, *rest, *(a + b for a in alphabet for b in alphabet)]
