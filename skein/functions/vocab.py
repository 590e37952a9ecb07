"""Closed vocabularies and word lists.

Fixed values: results must equal those of the format these layers come from.
"""

APOSTROPHES = "’‘ʼ´`"
UNKNOWN = "(unknown)"
UNATTRIBUTED = "(unattributed)"
NO_ADDRESSEE = "(none)"
UNSTATED = "(unstated)"
CARRIED = "-"
UNTYPED = "(untyped)"

NODE_TYPES = ("individual", "generic", "class", "hypothetical-simile", "non-person", "deictic")
PERSON_TYPES = ("individual", "generic", "class")
COHORT_TYPES = ("class", "generic")
FRAMES = ("literal", "simile", "prophecy", "reported")
ASSERTING_FRAMES = ("reported", "prophecy", "simile")
STATUSES = ("present", "mentioned")
SIGNALS = ("strong", "weak", "none")
SOURCES = ("code", "llm", "none")

ARTICLES = ("il", "lo", "la", "i", "gli", "le", "un", "una")
PREPOSITIONS = ("di", "da", "della", "dello", "dei", "degli", "delle", "dell", "de'", "del")
TITLES = (
    "conte", "contessa", "ser", "messer", "frate", "fra", "re", "donno", "imperadore", "imperador", "imperadrice",
    "arcivescovo", "vescovo", "marchese", "duca", "papa", "san", "santa", "santo",
)
INFIX_ARTICLES = ("il", "lo", "la", "l'", "i", "gli", "le")
DEICTIC_HEADS = (
    "quel", "quello", "quella", "quei", "quegli", "quelle", "questo", "questa", "questi", "queste", "costui",
    "costei", "costoro", "colui", "colei", "coloro", "chi", "cui", "ciò", "tale", "tali",
)
GOVERNORS = (
    "di", "del", "dello", "della", "dei", "degli", "delle", "da", "dal", "dallo", "dalla", "dai", "dagli", "dalle",
    "de", "de'", "d'", "a", "in", "con", "su", "per", "tra", "fra", "suo", "sua", "suoi", "sue", "mio", "mia",
    "miei", "mie", "tuo", "tua", "tuoi", "tue", "nostro", "nostra", "vostro", "vostra", "loro", "altro", "altra",
    "altri", "altre", "l'altro", "l'altra", "quel", "quello", "quella", "quei", "quegli", "quelle", "questo", "questa",
)
EXCLUDE_BARE = ("Dio",)
FIRST_PERSON = {"strong": ("io", "i'", "ïo"), "weak": ("mi", "m'", "me", "meco"), "plural": ("noi", "ci", "ne")}
READER_FORMS = ("lettor", "lettore", "lettori")
ELIDABLE = (
    "lo", "la", "una", "dello", "della", "nello", "nella", "allo", "alla", "dallo", "dalla", "sullo", "sulla",
    "quello", "quella", "questo", "questa",
)
VOWELS = "aeiouàèéìíòóùúAEIOUÀÈÉÌÍÒÓÙÚ"
CONTENT_STOP = (
    "di", "del", "della", "dello", "dei", "degli", "delle", "dell", "che", "con", "la", "il", "lo", "le", "i", "gli",
    "un", "una", "uno", "e", "ed", "o", "a", "ad", "da", "in", "su", "per", "tra", "fra", "l", "d", "se",
)
SENTENCE_OPENERS = (
    "The", "A", "An", "And", "But", "Or", "Nor", "So", "Yet", "For", "As", "When", "While", "Then", "Here", "There",
    "Now", "Thus", "He", "She", "They", "It", "We", "I", "His", "Her", "Their", "This", "That", "These", "Those",
    "Who", "Whom", "Where", "With", "In", "On", "At", "To", "Of", "By", "From", "After", "Before", "Though",
    "Although", "Because", "If", "Upon", "Once", "Soon", "Still", "Both", "One", "Two", "Each", "All", "No", "Not",
    "Its", "Our", "Your",
)
#: the closed list of predicates, each with the verbs it stands for; a verb may have several
VERBS = {
    "speaks-to": ("speaks", "talks"),
    "addresses": ("addresses", "greets"),
    "asks": ("asks", "questions", "inquires", "wonders"),
    "answers": ("answers", "responds", "replies", "retorts"),
    "tells": ("tells", "informs", "relates", "reports", "asserts", "claims", "declares"),
    "commands": ("commands", "orders", "instructs", "directs", "urges", "bids", "exhorts"),
    "warns": ("warns", "cautions"),
    "rebukes": ("rebukes", "reproaches", "condemns", "criticizes", "scolds", "blames"),
    "praises": ("praises", "blesses", "honors", "thanks"),
    "prophesies": ("prophesies", "foretells", "predicts"),
    "calls": ("calls", "summons", "invokes", "shouts", "cries", "exclaims"),
    "pleads-with": ("pleads", "begs", "implores", "entreats", "prays"),
    "names": ("names", "calls"),
    "sees": ("sees", "beholds", "watches", "notices", "perceives", "spots", "spies"),
    "hears": ("hears", "listens"),
    "meets": ("meets", "encounters", "finds", "approaches", "joins", "greets"),
    "recognizes": ("recognizes", "knows"),
    "guides": ("guides", "leads", "directs"),
    "follows": ("follows", "accompanies"),
    "brings": ("brings", "takes", "carries", "draws"),
    "sends": ("sends", "dispatches"),
    "gives": ("gives", "offers", "grants", "hands", "presents"),
    "shows": ("shows", "reveals", "points", "displays"),
    "touches": ("touches", "embraces", "grasps", "seizes", "grabs", "holds"),
    "strikes": ("strikes", "hits", "beats", "attacks", "wounds"),
    "defeats": ("defeats", "overcomes", "conquers", "vanquishes", "destroys", "kills", "slays", "devours", "consumes"),
    "chases": ("chases", "hunts", "pursues", "drives", "blocks", "hinders"),
    "punishes": ("punishes", "torments", "tortures", "afflicts"),
    "protects": ("protects", "defends", "saves", "rescues", "shields"),
    "compares": ("compares", "likens", "resembles"),
    "opposes": ("opposes", "resists", "defies", "rebels"),
}
PREDICATES = tuple(VERBS)
#: words that end as verbs do and are none
NO_VERBS = ("this", "his", "its", "thus", "plus", "was", "perhaps", "across", "towards", "as", "us", "is", "has", "does")
FALLBACK_PREDICATE = "relates-to"
