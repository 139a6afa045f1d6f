"""Word lists, tables and constants of the document rules."""

from __future__ import annotations

from .name_table import FAMILIES

# The rules give right results only with exactly these lists, in this order.
COUNTRIES = """Afghanistan, Albania, Algeria, Armenia, Azerbaijan, Bangladesh, Belarus, Belgium, Bosnia, Bulgaria, Cameroon,
Chad, Colombia, Croatia, Cyprus, DRC, Egypt, Eritrea, Ethiopia, France, Gambia, Georgia, Germany, Ghana, Greece, Guinea,
Hungary, India, Iran, Iraq, Israel, Italy, Jordan, Kosovo, Lebanon, Libya, Mali, Malta, Morocco, Nepal, Netherlands,
Nigeria, Pakistan, Palestine, Poland, Romania, Russia, Serbia, Sierra Leone, Somalia, Spain, Sri Lanka, Sudan, Syria,
Turkey, Uganda, Ukraine, Vietnam, Yemen, Zimbabwe"""
DEMONYMS = """Afghan: Afghanistan, Albanian: Albania, Algerian: Algeria, Armenian: Armenia, Azerbaijani: Azerbaijan,
Bangladeshi: Bangladesh, Belarusian: Belarus, Belgian: Belgium, Bosnian: Bosnia, Bulgarian: Bulgaria,
Cameroonian: Cameroon, Chadian: Chad, Colombian: Colombia, Croatian: Croatia, Cypriot: Cyprus, Congolese: DRC,
Egyptian: Egypt, Eritrean: Eritrea, Ethiopian: Ethiopia, French: France, Gambian: Gambia, Georgian: Georgia,
German: Germany, Ghanaian: Ghana, Greek: Greece, Guinean: Guinea, Hungarian: Hungary, Indian: India, Iranian: Iran,
Iraqi: Iraq, Israeli: Israel, Italian: Italy, Jordanian: Jordan, Kosovar: Kosovo, Lebanese: Lebanon, Libyan: Libya,
Malian: Mali, Maltese: Malta, Moroccan: Morocco, Nepalese: Nepal, Nepali: Nepal, Dutch: Netherlands, Nigerian: Nigeria,
Pakistani: Pakistan, Palestinian: Palestine, Polish: Poland, Romanian: Romania, Russian: Russia, Serbian: Serbia,
Sierra Leonean: Sierra Leone, Somali: Somalia, Spanish: Spain, Sri Lankan: Sri Lanka, Sudanese: Sudan, Syrian: Syria,
Turkish: Turkey, Ugandan: Uganda, Ukrainian: Ukraine, Vietnamese: Vietnam, Yemeni: Yemen, Zimbabwean: Zimbabwe"""
# The extractor's demonyms: those above without Belgian and Sierra Leonean, then these.
MORE_DEMONYMS = """Rwandan: Rwanda, Burundian: Burundi, Kenyan: Kenya, Tanzanian: Tanzania, Senegalese: Senegal,
Sierra Leonean: Sierra Leone, Liberian: Liberia, Mauritanian: Mauritania"""
PERSON_PARTICLES = "al el ul abu abd abdu abdi bin bint ibn um umm ould wuld mac mc van von de di du del della ben bat bar"
SPAN_PARTICLES = "ibn bin bint abu abd abdi abdu abdel abdal um umm ben beni al el ul ould weld mac mc de di du van von te ter"
FAMILY_TERMS = """wife husband spouse partner daughter son children child mother father brother sister grandfather
grandmother grandchild nephew niece cousin uncle aunt sibling parents"""
MONTHS = "January February March April May June July August September October November December"
SHORT_MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec"
FRENCH_MONTHS = "janvier février mars avril mai juin juillet août septembre octobre novembre décembre"
LEGAL_PHRASES = """Preliminary Considerations, Subsidiary Protection, Refugee Status, International Protection,
Qualification Directive, European Union, United Nations, High Commissioner, Protection Agency, Article Nine, Article Ten,
Article Fifteen, Grounds Appeal, Member States, Human Rights, Geneva Convention, Security Situation, Risk Assessment,
Personal Interview, Evaluation Report, Protection Tribunal, Supreme Court, Administrative Court, Country Guidance,
Country Information, Home Area, Appeal Submission, Reply Submissions, Protection Appeals, Honourable Tribunal,
Refugee Convention, Dublin Regulation, Common European, Asylum System, Reception Conditions, Procedural Directive,
Return Directive, Border Procedure, Accelerated Procedure, Admissibility Procedure, Case Worker, Case Officer,
Presenting Officer, Legal Representative, Asylum Seeker, Protection Officer, Country Expert, Board Member, Tribunal Member,
Panel Member, Summary Grounds, Factual Background, Legal Framework, Relevant Law, Applicable Law, Legal Basis,
Legal Arguments, Factual Summary, Key Facts, Background Facts, Relevant Facts"""
LEGAL_ENDINGS = """Act Law Code Rule Order Decree Regulation Directive Convention Protocol Annex Article Section Chapter Part
Clause Schedule Appendix Report Decision Assessment Evaluation Interview Submission Review Notice Letter Form Document
Certificate Card Permit Visa Status Procedure Process Policy Guidance Instruction Circular Bulletin"""
LEGAL_SINGLES = """The This That These Those Their There And But For With From Into Upon Her His She Him They Them Yes No Not Any
All Each Both Article Section Annex Chapter Part Directive Convention Regulation Protocol Act Law Court Tribunal Agency
Board Panel Committee Applicant Appellant Respondent Claimant Defendant Ref Case File No Number Para Page Note See Ibid Id
Op Cit Supra Infra"""
NOT_NAMES = """the this that these their and but for with from her his she they yes no not any all article section court
tribunal agency applicant appellant respondent claimant ref case file page date born nationality passport id number name
surname family given address form application interview hearing decision appeal status refugee asylum document certificate
birth marriage death police report medical note letter office ministry authority government country city place signature
signed issued valid"""
DOCUMENT_TYPES = {
    "PASSPORT": ("Passport", "passport; جواز; passeport; pasaporte; reisepass; paspoort"),
    "NATIONAL_ID": ("National Identity Card", "identity card; national id; carte nationale; personalausweis; هوية; بطاقة"),
    "BIRTH_CERT": ("Birth Certificate", "birth certificate; certificate of birth; شهادة ميلاد; extrait de naissance; geburtsurkunde"),
    "MARRIAGE_CERT": ("Marriage Certificate", "marriage certificate; عقد زواج; acte de mariage; heiratsurkunde"),
    "ASYLUM_APPLICATION": ("Asylum Application", "asylum application; application for international protection; refugee status; international protection; طلب اللجوء; demande d'asile"),
    "INTERVIEW_RECORD": ("Interview Record", "interview record; substantive interview; personal interview; interview transcript; hearing record"),
    "COURT_DECISION": ("Court / Tribunal Decision", "tribunal; court decision; appeal decision; judgment; ruling; decision of the; international protection appeals"),
    "POLICE_REPORT": ("Police / Security Report", "police report; garda; constabulary; تقرير الشرطة; rapport de police; security report"),
    "MEDICAL_REPORT": ("Medical Report", "medical report; clinical report; health assessment; psychological assessment; psychiatric assessment; médical"),
    "TRAVEL_DOC": ("Travel Document", "travel document; laissez-passer; emergency travel; convention travel"),
    "REGISTRATION": ("Registration Form", "registration form; registration card; eurodac; dublin regulation"),
    "UNKNOWN": ("Unknown Document", ""),
}
SUGGESTIONS = {
    "CONFLICTING_DOB": "Review pages listed and confirm correct date of birth. Check if one date is a document issue date.",
    "INVALID_PASSPORT_NO": "Possible OCR confusion: 0/O, 1/I/L, 8/B. Manually verify against original document image.",
    "SPELLING_INCONSISTENCY": "Verify spelling against primary identity document. Record all known aliases.",
}
NO_SUGGESTION = "Manual review required."
SCRIPTS = {"arabic": r"؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿", "ethiopic": r"ሀ-፿ᎀ-᎟", "bengali": r"ঀ-৿", "cyrillic": r"Ѐ-ӿ", "latin": "A-Za-z"}
SCRIPT_LANGUAGES = {"arabic": "ara+eng+fra+urd+kur", "ethiopic": "amh+tir+eng", "bengali": "ben+eng", "cyrillic": "rus+eng", "latin": "eng+fra+som+tur"}
LANGUAGES = {
    "ara": ("Arabic", "arabic", True), "eng": ("English", "latin", False), "fra": ("French", "latin", False), "som": ("Somali", "latin", False),
    "tir": ("Tigrinya", "ethiopic", False), "amh": ("Amharic", "ethiopic", False), "urd": ("Urdu", "arabic", True), "kur": ("Kurdish", "arabic", True),
    "ben": ("Bengali", "bengali", False), "tur": ("Turkish", "latin", False), "rus": ("Russian", "cyrillic", False),
}
# End of fixed values.


def listed(text: str) -> list[str]:
    """Entries of a comma list, or of a word list without commas."""
    return [x.strip() for x in text.replace("\n", " ").split(",")] if "," in text else text.split()


def mapped(text: str) -> dict[str, str]:
    return dict(tuple(y.strip() for y in x.split(":")) for x in listed(text))


DETECT_DEMONYMS = mapped(DEMONYMS)
EXTRACT_DEMONYMS = {k: v for k, v in DETECT_DEMONYMS.items() if k not in ("Belgian", "Sierra Leonean")} | mapped(MORE_DEMONYMS)

#: Transliteration families known without a table of one's own; ``names.read_table`` reads others.
NAME_FAMILIES = dict(line.split(": ") for line in FAMILIES.splitlines())


def name_rows(families: dict[str, str] | None = None) -> list[tuple[str, str, int, int]]:
    """(variant, canonical, entry_ord, key_ord): the last entry wins a shared variant, its first place stays."""
    canonical: dict[str, tuple[str, int]] = {}
    for entry, (name, variants) in enumerate((families or NAME_FAMILIES).items()):
        for v in variants.split():
            canonical[v.lower()] = (name, entry)
    return [(v, c, e, k) for k, (v, (c, e)) in enumerate(canonical.items())]
