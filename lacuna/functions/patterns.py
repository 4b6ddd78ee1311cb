"""Patterns in Python's dialect, and their translation to the JVM's.

The strings and sets below are fixed values: results depend on them letter by letter.
"""

from __future__ import annotations

from functools import lru_cache

#: Letters, numbers and the underscore, inside a class; white space, inside a class.
W = r"\p{L}\p{N}_"
S = r" \t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Starts of Java patterns: only the line feed ends lines.
UNIX = "(?d)"
NOT_AFTER_WORD, NOT_BEFORE_WORD = f"(?<![{W}])", f"(?![{W}])"


@lru_cache(maxsize=None)
def java(pattern: str) -> str:
    """The same language for java.util.regex as for Python's re."""
    out, at, inside = [UNIX], 0, False
    while at < len(pattern):
        if pattern.startswith(r"[^\W\d_]", at) and not inside:
            out.append(r"[\p{L}\p{Nl}\p{No}]")
            at += 8
            continue
        two = pattern[at : at + 2]
        if two[0] == "\\":
            bracket = (lambda x: x) if inside else "[{}]".format
            out.append({
                r"\w": bracket(W), r"\W": f"[^{W}]", r"\d": r"\p{Nd}", r"\s": bracket(S), r"\S": f"[^{S}]",
                r"\b": f"(?:(?<=[{W}])(?![{W}])|(?<![{W}])(?=[{W}]))",
            }.get(two, two))
            at += 2
            continue
        if pattern.startswith(("(?i)", "(?i:"), at):
            out.append("(?iu" + pattern[at + 3])
            at += 4
            continue
        if two[0] == "[" and not inside:
            inside = True
            out.append("[")
            at += 1
            if pattern[at] == "^":
                out.append("^")
                at += 1
            continue
        inside = inside and two[0] != "]"
        out.append(two[0])
        at += 1
    return "".join(out)


# Fixed values -----------------------------------------------------------------------------------------------------

TYPES = (
    "private_person", "private_company", "lawyer", "court_official", "expert", "authority", "public_body", "residence",
    "place", "address", "identifier", "parcel_number", "occupation", "birth_date",
)
PERSON = ("private_person", "lawyer", "court_official", "expert")
PLACE = ("residence", "place")
AUTHORITY = ("authority", "public_body")
NAMED = (*PERSON, "private_company", "public_body", "authority")
OPEN_TO_ALL = ("court_official", "lawyer", "expert", "authority", "public_body", "authority_address")

STOPWORDS = {
    "de": ("der", "die", "und", "das", "nicht", "ist", "des", "den", "dem", "mit"),
    "fr": ("le", "la", "les", "des", "et", "est", "une", "pour", "que", "du"),
    "it": ("il", "che", "di", "non", "per", "una", "sono", "gli", "della", "del"),
}
STOP = ("AG", "SA", "GmbH", "Sagl", "Holding", "Immobilien", "Treuhand", "Bau", "Transport", "Garage")

TITLES = (
    r"^(?:(?:Herrn?|Frau|Dr\.|Dres\.|Prof\.|lic\.|iur\.|med\.|phil\.|Rechtsanwalt|Rechtsanwältin|RA|"
    r"Fürsprecher(?:in)?|Bundesrichter(?:in)?|Gerichtsschreiber(?:in)?|Oberrichter(?:in)?|"
    r"Richter(?:in)?|Präsident(?:in)?|M\.|MM\.|Mme|Mmes|Mlle|Me|Maître|Juge|Greffier|Greffière|docteure?s?|médecin|"
    r"avv\.|avvocato|avvocata|sig\.(?:ra)?|signor[ae]?|dott\.(?:ssa)?|dottor(?:e|essa)?|[Gg]iudic[ei]|cancellier[ae]|"
    r"Juges|fédéra(?:l|le|ux|les)|federal[ei]|le|la|les|il|lo|der|die)\s*:?\s+)+"
)
ROLE_NOUN = (
    r"(?i)^(?:(?:die|der|den|des|le|la|les|l'|il|lo|i|gli)\s+)?(?:beschwerde(?:führer|gegner)\w*|kläger\w*|beklagte\w*|"
    r"gesuch(?:steller|sgegner)\w*|berufungs\w+|beschuldigte\w*|angeklagte\w*|versicherte\w*|ehe(?:frau|mann|gatte|gattin)\w*|"
    r"mutter|vater|kind(?:er)?|sohn|tochter|mieter\w*|vermieter\w*|arbeit(?:geber|nehmer)\w*|erben?|"
    r"recourant\w*|intimé\w*|requérant\w*|demandeu\w+|défendeu\w+|enfants?|épou\w+|mère|père|fils|fille|prévenu\w*|héritiers?|"
    r"ricorrent\w+|opponent\w+|figli\w*|moglie|marito|padre|madre|imputat\w+|insorgent\w+|interessat\w+|assicurat\w+|eredi)"
    r"(?:$|\s+(?:des|der|dem|du|de|del|della|dei|degli|of)\b)"
)
NAME_WORD = r"(?<!\w)[A-ZÀ-ÖØ-Þ][^\W\d_]+"
OFFICIAL_ROLE = r"(?i)\b(?:judge|clerk|registrar|\w*richter\w*|gerichtsschreiber\w*|juges?|greffi\w+|giudic[ei]|cancellier\w+)\b"
INSTITUTION = (
    r"(?i)\b(?:cour|chambre|\w*gericht(?:s|e|es|en|shof)?|tribuna\w+|kammer|abteilung|corte|camera|office|amt|\w+amt|departement|"
    r"direktion|\w+direktion|commission|kommission|ministère|ministero|staatsanwaltschaft|pretura|pretore)\b"
)
PUBLIC_TITLE = (
    r"(?i)(?:rechtsanw\w*|fürsprech\w*|advokat\w*|avocat\w*|(?<!\w)me|(?<!\w)avv|avvocat\w*|\w*richter\w*|"
    r"gerichtsschreiber\w*|greffi\w+|juges?|giudic[ei]|cancellier\w+)\W{0,3}(?:(?:dr|dott|prof|lic|iur|med)\.?\s*)*$"
)
LAWYER_ROLE = r"(?i)\b(?:lawyer|attorney|counsel|rechtsanw\w+|fürsprech\w*|avocat\w*|avvocat\w*)\b"
CITATION = r"(?i)\b(?:art|ATF|BGE|DTF|cpv|al|abs|lit|let|fr|chf|sr|rs|consid|E)\b\.?|_\d+/\d{4}|\d+\s*/\s*\d{4}"
SPLIT = r"\s*(?:,|;|/|\bet\b|\bund\b|\be\b|\band\b)\s*"

PLATE_CUE = r"(?i)kontrollschild|kennzeichen|nummernschild|plaque|immatricul|targa|fahrzeug|véhicule|veicolo"
STREET = (
    r"(?:[A-ZÄÖÜ][\wäöüß.-]*(?:strasse|straße|str\.|gasse|weg|platz|allee|rain|ring|halde|matte|quai|steig)"
    r"|(?:Rue|rue|Avenue|avenue|Av\.|Chemin|chemin|Ch\.|Route|route|Rte|Place|place|Boulevard|Quai|quai|Impasse|"
    r"Via|via|Viale|viale|Piazza|piazza|Vicolo|vicolo|Strada|strada)[ \t]+(?:[\w'’.-]+[ \t]+){0,3}?[\w'’.-]+)"
    r"[ \t]+\d{1,4}[a-z]?"
)
TOWN = r"(?:CH-)?[1-9]\d{3}[ \t]+[A-ZÄÖÜÉÈ][\w'’-]*\.?(?:[ \t]+(?:[A-ZÄÖÜÉÈ][\w'’-]*|bei|sur|près|de|di|am|an|im))?"
DETECTORS = (
    ("identifier", r"\b756[.\s]?\d{4}[.\s]?\d{4}[.\s]?\d{2}\b"),
    ("identifier", r"\b(?:CH|LI)\d{2}(?:\s?[0-9A-Z]{4}){4}\s?[0-9A-Z]\b"),
    ("identifier", r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"),
    ("identifier", r"(?<![\w+])(?:\+41\s?|0041\s?|0)(?:\(0\)\s?)?[1-9]\d\s?\d{3}\s?\d{2}\s?\d{2}\b"),
    ("address", STREET + r"(?:,\s*Postfach(?:\s+\d+)?)?(?:,\s*" + TOWN + ")?"),
    ("address", r"(?<=, )" + TOWN + r"(?=\s*(?:,|\n|$))"),
    ("address", r"\b(?:Postfach|case postale|casella postale)\s+\d+"),
)
PARCEL = (
    r"(?:Parzelle|Parz\.|Grundstück|GB-Nr\.|Kat\.-Nr\.|Katasternummer|parcelle|bien-fonds|particella|fondo|mappale)"
    r"\s*(?:Nr\.|Nr|n°|no|n\.)?\s*(\d[\d'’.]*\d|\d)"
)
PLATE = r"\b(?:AG|AI|AR|BE|BL|BS|FR|GE|GL|GR|JU|LU|NE|NW|OW|SG|SH|SO|SZ|TG|TI|UR|VD|VS|ZG|ZH)\s?\d{1,3}(?:[ '’]?\d{3})?\b"

LEGAL_FORM = (
    r"(?:\s*,)?\s+(?:AG|SA|GmbH|Sàrl|Sagl|S\.à\s?r\.l\.|S\.r\.l\.|Srl|S\.A\.|Ltd\.?|Inc\.|SE|KG|LLC|"
    r"in Liquidation|en liquidation|in liquidazione)$"
)
GENITIVE = r"(?:s|’s|'s)?"
BIRTH_CUE = r"(?i)geb(?:oren|\.)|jahrgang|né[e]?\b|naissance|nat[oa]\b|nascita|born"
SOCIAL_INSURANCE = (
    r"(?i)sozialversicherung|(?:invaliden|unfall|kranken|arbeitslosen|militär)versicherung|berufliche Vorsorge|"
    r"ergänzungsleistung|soziale Sicherheit|IV-Stelle|SUVA|assurances? sociales?|"
    r"assurance-(?:invalidité|accidents|maladie|chômage)|prévoyance professionnelle|prestations complémentaires|"
    r"sécurité sociale|office AI|assicurazion[ei] social[ei]|assicurazione (?:invalidità|contro gli infortuni|malattia|"
    r"contro la disoccupazione)|previdenza professionale|prestazioni complementari|sicurezza sociale|Ufficio AI"
)

DECISION_CUE = (
    r"(?i)urteil|entscheid|beschluss|verfügung|verfahren|geschäft|prozess|arrêt|jugement|décision|"
    r"ordonnance|cause|procédure|sentenza|decisione|decreto|incarto|procedimento"
)
CASE_NUMBER = (
    r"\b(?:[A-Z]{1,5}[./ -]?\d{2,4}[./ -]\d{1,6}(?:[./-][A-Z0-9]{1,4})?|[A-Z]{2,}\d{4,}(?:[-/][A-Z0-9]{1,4})*|"
    r"[A-Z]{1,5}/\d{1,6}/\d{4}|\d{2}\.\d{4}\.\d{1,5})\b"
)
FEDERAL_CASE = r"\b\d{1,2}[A-Z]{1,2}_\d+/\d{4}\b|\b[A-F]-\d+/\d{4}\b|\bBGE\b|\bSR\b|\bArt\b"
SCREEN_PLACEHOLDER = r"\b[A-Z]{1,2}\.(?:_{2,})?|\[…\]|\[\.\.\.\]"
DATE_OR_AMOUNT = (
    r"\b\d{1,2}\.?\s*[^\W\d_]+\.?\s+\d{4}\b|\b\d{1,2}\.\d{1,2}\.\d{2,4}\b|"
    r"(?i:\b(?:fr|chf)\.?\s*)[\d'’.,]+(?:\.[-–]{1,2})?"
)
TITLE_WORD = (
    r"(?i)\b(?:rechtsanw\w*|fürsprech\w*|advokat\w*|avocat\w*|avvocat\w*|avv|dr|prof|me|maître|vertreten|"
    r"représenté\w*|patrocinat\w*)\b\.?"
)

PLACEHOLDER = r"(?<![\w.])([A-Z](?:\.[A-Z])*)\.?_{3,}"
MARKER = r"[A-Z]{1,2}\.(?:_{3,})?|\[…\]"
LEGAL_FORM_AFTER = r"\s*(?:AG|SA|GmbH|Sàrl|Sagl|S\.r\.l\.|Srl|S\.A\.|Ltd|Inc|SE|KG|LLC|& Co|Holding|Genossenschaft)\b"
ORG_BEFORE = (
    r"(?i)(?:firma|société|ditta|klinik|clinique|clinica|garage|bank|banque|banca|stiftung|fondation|fondazione|verein|"
    r"association|associazione|hotel|restaurant|spital|hôpital|ospedale)\s+$"
)
LAWYER_BEFORE = r"(?:Rechtsanwalt|Rechtsanwältin|Fürsprecher(?:in)?|Advokat(?:in)?|avocat[e]?|Me|Maître|avv\.|avvocat[oa])\s+$"
PLACE_BEFORE = (
    r"(?i)(?:wohnhaft in|mit Sitz in|\bin|Gemeinde|Einwohnergemeinde|Bezirk|Bezirksgericht|Kreisgericht|Regionalgericht|"
    r"Amtsgericht|Stadt|domiciliée?s? à|sise? à|commune de|district de|arrondissement de|ville de|"
    r"domiciliat[oaie] a|con sede a|Comune di|Pretura di|Municipio di)\s+$"
)
FEMALE_AFTER = (
    r"(?s)^.{0,60}?\b(?:Beschwerdeführerin|Klägerin|Gesuchstellerin|Gesuchsgegnerin|Berufungsklägerin|Ehefrau|Mutter|Tochter|"
    r"Schwester|recourante|intimée|requérante|demanderesse|défenderesse|épouse|mère|fille|sœur|domiciliée|née\b|"
    r"moglie|madre|figlia|sorella|domiciliata|nata\b|cittadina)"
)
FEMALE_BEFORE = r"(?:Frau|Mme|Madame|signora|sig\.ra|Ehefrau|Mutter|Tochter|épouse|mère|fille|moglie|madre|figlia)\s+$"
PERSON_AFTER = (
    r"^,?\s*(?:Beschwerdeführer|Beschwerdegegner|Kläger|Beklagte|Gesuchsteller|Berufungskläger|Beschuldigte|Angeklagte|geboren|"
    r"vertreten|recourant|intimé|requérant|demandeur|défendeur|né|représenté|ricorrente|opponente|attore|convenuto|nat[oa]|patrocinat)"
)
PERSON_BEFORE = (
    r"(?:Herr|Frau|M\.|Mme|signor[a]?|Ehemann|Ehefrau|Sohn|Tochter|Vater|Mutter|Kind|fils|fille|père|mère|épou[sx]e?|"
    r"figli[oa]|padre|madre|moglie|marito|Dr\.|med\.)\s+$"
)
COMPOSITION = (
    r"(?s)(?:Besetzung|Composition|Composizione|Mitwirkend:?)\s*(.{3,700}?)\s*"
    r"(?:Parteien|Verfahrensbeteiligte|Participants|Parties|Parti\b|Partecipanti|Beschluss vom|Urteil vom|Statuant|\*{3,}|in Sachen)"
)
ROLE_WORDS = (
    r"(?i)\b(?:Bundes(?:verwaltungs|straf)?richter(?:in|innen)?|Ersatz(?:ober)?richter(?:in)?|Ober(?:richter|richterin)|Richter(?:in|innen)?|"
    r"Gerichtsschreiber(?:in)?|Gerichtspräsident(?:in)?|Einzelrichter(?:in)?|Instruktionsrichter(?:in)?|Kammerpräsident(?:in)?|"
    r"Abteilungspräsident(?:in)?|Präsident(?:in)?|Vorsitzende[r]?|Vorsitz|nebenamtliche[r]?|Juges?|fédéra(?:l|ux|le|les)|Président[e]?|"
    r"Greffi(?:er|ère)|suppléant[e]?|unique|giudic[ei]|federal[ei]|president(?:e|essa)|del collegio|cancellier[ea]|in qualità di|"
    r"lic\.|iur\.|phil\.|Dr\.|MLaw|Prof\.|M\.|Mme|MM\.|Mmes|les|la|le|et|und|sowie|e|unico|Ire|IIe|Cour|Abteilung)(?!\w)"
)
KEEP_SPLIT = r"[,;:()\n/.]|\s{2,}|\s(?:et|und|e)\s"
LAWYER = (
    r"(?:vertreten durch|v\.d\.|a\.v\.d\.|représentée?s? par|assistée?s? par|patrocinat[oaie]|rappresentat[oaie])\s+"
    r"(?:(?:Rechtsanwalt|Rechtsanwältin|Fürsprecher(?:in)?|Advokat(?:in)?|Dr\.|lic\.\s?iur\.|MLaw|Prof\.|Me|Maître|dall'|dalla|dal|da|avv\.|avvocat[oa])\s*)*"
    r"([A-ZÄÖÜÉ][\wäöüéèàç'’-]+(?:\s+(?:von|van|de|di|da|del|della)?\s*[A-ZÄÖÜÉ][\wäöüéèàç'’-]+){0,3})"
)
NOT_NAMES = (
    "Inhaberin", "Inhaber", "Rechtsdienst", "Departement", "Direktion", "Amt", "Office", "Ufficio", "Service", "Kanton",
    "Canton", "Cantone", "Mitglied", "Mitglieder", "Zustimmung", "Rechtsanwalt", "Rechtsanwältin", "Fürsprecher",
    "Fürsprecherin", "Advokat", "Advokatin", "Maître", "Avocat", "Avvocato", "Avvocata", "Gerichtsschreiber",
    "Gerichtsschreiberin", "Präsident", "Präsidentin", "Vizepräsident", "Vizepräsidentin", "Ersatzrichter", "Ersatzrichterin",
)
RESIDENCE_CUE = (
    r"(?:wohnhaft in|Wohnsitz in|wohnt in|wohnte in|mit Sitz in|mit damaligem statutarischen Sitz in|Sitz in|"
    r"domiciliée? à|dont le siège (?:se situe|est) (?:à|en Ville de)|avec siège à|sise? à|"
    r"con sede a|sede effettiva a|domiciliat[oa] a|residente a)\s+"
    r"((?:[A-ZÄÖÜÉÈ][\w'’-]+)(?:[ -](?:[A-ZÄÖÜÉÈ][\w'’-]+|de|di|am|an|bei))*)"
)
