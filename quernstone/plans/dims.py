"""Small constant tables for the registered queries, made for the synthetic texts."""

from __future__ import annotations

from quernstone.config import Topic

FIXED_QUERIES = [(0, "the station shall be near the other"), (1, "Réaux eauation, nicht oder schung"), (2, "threaing the intion oredat")]
PAGE_QUERY = "thther that the ing"

TOPICS = [
    Topic("places", ("station", "haus", "maison"), ("location", "places", "ands"), ("/en/",)),
    Topic("words", ("tion", "ung"), ("wording", "ation"), ()),
    Topic("signs", ("que", "cion"), ("signed", "quer"), ("/fr/", "/es/")),
]

#: Normalised phrases of each topic, in the order that settles ties.
TOPIC_PHRASES = [
    ("verbs", ("thing", "ing the", "ation")),
    ("articles", ("the", "la", "der", "el")),
    ("links", ("with the", "und der", "que la", "avec")),
]
FLOWS = {"first": ("la que", "the and of"), "second": ("der die und", "with by")}
INTENTS = {"open": ("the", "una", "le la"), "mark": ("and the", "und", "que"), "date": ("with", "de la", "des")}
STEPS = ["view", "signup", "purchase", "click"]
VISITOR = ("tion the", "eau", "ung")
FOLLOW_UPS = [(("eau", "scam"), "scams,help,official"), (("thing", "frais"), "fees,forms,next"), (("ung", "wait"), "timeline,status,next")]
#: Domains taken as official in the synthetic pages.
DOMAINS = ("example.com", "example.org")


#: A small checklist for each of two flows, and what its steps are called.
FLOW_STEPS = [("first", 0, "view"), ("first", 1, "click"), ("second", 0, "signup"), ("second", 1, "purchase"), ("second", 2, "click")]
STEP_PARTS = [("first", 0, "open", ("la que", "the other one")), ("first", 1, "close", ("and of the",)), ("first", 2, "sign", ("der und", "que de la")), ("first", 3, "wait", ("with the",))]
LABELS = {"complete": "complete", "due": "Due", "not_set": "not set", "completed": "Completed", "remaining": "Remaining", "key_dates": "Key dates", "not_calculated": "not calculated", "none": "none"}
#: Intents of typed commands.
TASKS = {
    "open": ("the", "una"), "summary": ("und der",), "checklist": ("zzz", "le la"), "summary_phrase": ("der die und",), "question": ("que la", "with the"), "date_noun": ("and",), "date_verb": ("of the", "des"),
    "undo": ("la le",), "mark": ("and the", "und"), "all": ("all", "ein"), "clear": ("de la",), "reminder": ("que",), "create": ("el",), "link": ("of",), "resource": ("in",), "privacy": ("to",), "capability": ("et", "zu"),
}
LINKS = [(("que la", "und der"), "https://example.com/status"), (("the", "de"), "https://example.com/fees"), (("und",), "https://example.com/forms")]
