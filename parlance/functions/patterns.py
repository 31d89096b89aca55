"""Word lists, patterns and constants that define the results."""

# All of this module.

URL = r"https?://\S+|www\.\S+"
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?:\+?\d[\d\-\.\(\)\s]{7,}\d)"
HANDLE = r"@[A-Za-z0-9_]{1,15}"
LONG_NUMBER = r"\b\d{5,}\b"
SIGNATURE = r"[\^/~\-]\s*([A-Z][A-Za-z]{0,8})\s*$"
NON_LATIN = r"[\x{0400}-\x{04FF}\x{0590}-\x{05FF}\x{0600}-\x{06FF}\x{0E00}-\x{0E7F}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]"
FUNCTION_WORDS = (
    "the is it my me i you your and but not no to of in on for with this that have has had do does did can cant cannot wont will would should "
    "why how what when where im ive its dont doesnt isnt are was were be been get got there just still any all please help thanks thank keep keeps "
    "work works working an a at if or so up out we us our they them their he she his her him being having doing getting need needs want wants "
    "new other some than then about from by as am every each much many more most very too now back again since after before yall trouble issue problem"
).split()
MIN_TOKENS = 4

HANDOFF = [
    r"\bsent you a (dm|direct message)\b", r"\b(shoot|send|drop) us a (dm|direct message)\b", r"\b(can|could|would) you dm us\b", r"\bdm us your\b",
    r"\bsend us a dm\b", r"\bwe'?ll take a look backstage\b", r"\bfollow (us )?(and|then) dm\b", r"\bslide into (our|the) dms\b",
    r"\bcheck your (dms|inbox)\b", r"\bwe('| a)?re following you\b", r"\blet'?s (take|continue) this (to|in) (dms?|private)\b", r"\bhead over to (our )?dms\b",
]
ACK_ONLY = [
    r"^\s*(so )?sorry (to hear|about) (that|this)", r"^\s*(oh no|aw|ah|yikes|eek)\b", r"^\s*thanks? (for|so much for) (reaching out|letting us know|the )",
    r"^\s*we('| a)?re (on it|here)\b", r"^\s*hey there[!.]?\s*$",
]
TROUBLESHOOT = [
    r"\btry(ing)?\b", r"\brestart(ing|ed)?\b", r"\bre-?install(ing|ed)?\b", r"\bun-?install(ing|ed)?\b", r"\blog(ging|ged)? (out|back in)\b",
    r"\bsign(ing|ed)? (out|back in)\b", r"\bclear(ing|ed|s)?\s+(the\s+|your\s+|out\s+)?cache\b", r"\bupdat(e|ing|ed)\s+(the\s+app|to\b|your\b)",
    r"\btoggl(e|ing|ed)\b", r"\b(switch|turn)(ing|ed)?\s+(it\s+)?(off|on)\b", r"\breboot(ing|ed)?\b", r"\bhead(ing)? (to|over)\b", r"\bgo to\b",
    r"\btap(ping|ped)?\b", r"\bclick(ing|ed)?\b", r"\bselect(ing|ed)?\b", r"\bopen(ing|ed)? (settings|the app)\b", r"\bcheck(ing|ed)? your\b",
    r"\bmake sure\b", r"\bensur(e|ing)\b", r"\b(dis|en)abl(e|ing|ed)\b", r"\bre-?connect(ing|ed)?\b", r"\bre-?add(ing|ed)?\b",
    r"\bdownload(ing|ed)? (it |them )?again\b", r"\boffline mode\b", r"\b(hard|force) clos(e|ing|ed)\b", r"\bswip(e|ing)\b", r"\bdelet(e|ing) (and|the app)\b",
]
STRONG_LINK = [r"<URL>", r"spotify\.com/(support|help)", r"support\.spotify", r"community\.spotify"]
WEAK_LINK = [r"https?://\S+", r"\bt\.co/\w+"]
FEATURE = [
    r"\b(add|cast) your vote\b", r"\bvote for (the|this) (official )?idea\b", r"\bofficial idea\b",
    r"\bpassed (your |this |that )?(feedback|idea|suggestion)s? (on )?to our (devs|team)\b", r"\byour feedback('s| has| is)? been (noted|passed|shared)\b",
]
POLICY = [
    r"\b(refunds?|charges?|billing|subscription|plan|trial|payment)\b.{0,60}\b(policy|process|works|handled|processed|takes|within|business days)\b",
    r"\byou can (cancel|change|switch|update|manage|remove|add)\b", r"\b(premium|family|duo|student) (plan|members?|accounts?)\b.{0,60}\b(need|must|can|allows?|requires?)\b",
    r"\bit (can )?takes? (up to )?\d+", r"\bonce (you|your)\b.{0,50}\b(will|should)\b", r"\bthis (happens|occurs) (when|because|if)\b", r"\bthe reason\b",
]
ACTION = [
    r"\bwe'?ve (now )?(fixed|resolved|updated|removed|added|refreshed|reset|restored|passed (this|it) on)\b",
    r"\b(this|that|it) (is|should be) (now )?(fixed|resolved|sorted|working|back up)\b", r"\bwe'?ve (logged|reported|escalated|flagged) (this|it)\b",
    r"\bour team (is|has) (aware|looking|fixed|working)\b", r"\ball (is )?(fixed|sorted|good) now\b",
]
REPLY_FAMILIES = [TROUBLESHOOT, STRONG_LINK, WEAK_LINK, FEATURE, POLICY, ACTION, HANDOFF, ACK_ONLY]

RULES = [
    ("legal_privacy_data_request", r"\b(gdpr|data protection|subject access request|right to be forgotten|my lawyer|legal action|sue you|solicitor|attorney|small claims|ombudsman|trading standards|press enquiry)\b"),
    ("suspected_account_compromise", r"\b(hacked|hacker|compromised|someone (else )?(is |has )?(using|accessing|on) my account|unauthorized (access|login)|unauthorised (access|login)|changed my (email|password) without|didn'?t (change|authorize) )\b"),
    ("billing_dispute", r"\b(charged (me )?(twice|two times|3 times|three times)|double[- ]charg|unauthorized charge|unauthorised charge|chargeback|dispute (the|this) charge|took money (from|out of) my (account|bank)|charged after (i )?cancel)\b"),
    ("refund_request", r"\b(refund me|want (a|my) refund|need (a|my) refund|give me my money back|money back|reimburse)\b"),
    ("abusive_or_distressed_language", r"\b(kill myself|suicid|self harm|i want to die)\b"),
]
KEYWORD_RULES = [
    *RULES,
    ("explicit_cancellation_threat", r"\b(cancel(ling|ing)? my (subscription|premium|account)|unsubscribe|switching to (apple|tidal|deezer|youtube)|done with (you|spotify))\b"),
    ("requires_account_specific_pii", r"\b(my account|my email|my username|my payment method|my card|my invoice|my billing)\b"),
    ("troubleshooting_already_failed", r"\b(already tried|tried (that|this|everything|all of that)|still (not|doesn'?t|won'?t)|none of (that|this) work|reinstalled? (twice|again|multiple))\b"),
]
MONEY = r"(?:[$£€]\s?\d|\b\d+[.,]\d{2}\b|\b\d+\s?(?:usd|gbp|eur|dollars?|pounds?|euros?)\b)"
SECURITY = r"\b(breach|reset my password|password reset|locked out|can'?t (log|sign) ?in|didn'?t authorise|didn'?t authorize|suspicious|someone else)\b"
SENTENCES = {
    "billing_dispute": "A specific charge is disputed, so a human needs to see the account and the payment record.",
    "suspected_account_compromise": "Possible account compromise - security cases go straight to a human.",
    "refund_request": "The customer is asking for money back; only a human can authorise that.",
    "legal_privacy_data_request": "Legal or data-protection request, which must be handled by a person.",
    "explicit_cancellation_threat": "The customer is cancelling or threatening to, so retention should handle it.",
    "abusive_or_distressed_language": "The message contains abusive or distressed language and needs a human.",
    "requires_account_specific_pii": "Answering needs private account details that cannot be discussed publicly.",
    "troubleshooting_already_failed": "They have already tried the standard fix, so the scripted reply would waste their time.",
    "low_model_confidence": "The classifier was not confident enough about the intent to answer automatically.",
    "no_retrieval_support": "No similar resolved thread was found, so any reply would be ungrounded.",
    "known_troubleshooting_flow": "This matches a known troubleshooting flow with good historical support.",
    "informational_answer": "This is a straightforward informational answer supported by past replies.",
    "chitchat_or_praise": "Praise or chit-chat, which needs no human attention.",
}

NEGATION = r"\b(not|n't|never|no longer|nothing|neither|nor|without|un\w+ed)\b"
SARCASM = r"(\bthanks a lot\b|\bgreat job\b|\bwonderful\b|\blove how\b|\bnice one\b|\bbrilliant\b|🙄|😒|/s\b|\bapparently\b|\bsupposedly\b)"
MULTI_INTENT = r"\b(also|and also|another thing|plus|as well as|second(ly)?|on top of that|besides)\b"
TRIGGER = r"\b(refund|charged twice|double charge|unauthorized|unauthorised|hack(ed)?|cancel|lawyer|legal|gdpr|data protection|fraud|scam|stolen|dispute|chargeback)\b"

PROBES = {
    "playback_streaming_issue": r"(won'?t|wont|not|stopped|keeps?) (play|playing|load|loading)|skip(s|ping)|buffer|no sound|cuts? out|stutter|downloaded.*(gone|disappear)|offline.*(not|won'?t)",
    "account_access_login": r"(can'?t|cant|unable to) (log ?in|login|sign ?in|access my account)|password reset|locked out|hacked|someone (else )?(is )?(using|on) my account|email (already )?in use",
    "billing_charge_dispute": r"charged (me )?(twice|again|two)|double charge|unauthorized charge|why (was i|am i) (being )?charged|took money|wrong amount|billed twice",
    "subscription_cancel_refund": r"cancel (my )?(subscription|premium|account)|want a refund|refund me|unsubscribe|stop (charging|billing|my subscription)",
    "plan_or_premium_management": r"student (discount|verification|premium)|family plan|duo plan|upgrade to premium|premium (isn'?t|not) active|change my plan|remove.*from my family",
    "content_missing_or_metadata": r"(isn'?t|not|no longer) (on|available on) spotify|can'?t find.*(album|song|artist)|missing (album|song|track)|why (isn'?t|is)n'?t.*on spotify|add.*(album|artist)",
    "device_integration_issue": r"(car|bluetooth|alexa|google home|sonos|chromecast|ps4|playstation|xbox|apple watch|carplay|android auto)",
    "app_bug_or_crash": r"crash(es|ing|ed)?|freez(es|ing)|app (keeps )?closing|force clos|won'?t open|black screen|glitch|bug",
    "feature_request_or_complaint": r"(please|pls) (add|make|bring|give us)|i wish|why (don'?t|dont) you|feature request|would be (great|nice) if|bring back",
}
#: The tenth probe is these two: the one matches and the other does not.
PRAISE = r"^.{0,200}(love (you|spotify)|thank you|best (app|service)|you'?re the best|amazing|❤|💚)"
NOT_PRAISE = r"^.*(problem|issue|help|fix|broken|can'?t)"

INTENTS = [
    "playback_streaming_issue", "account_access_login", "billing_charge_dispute", "subscription_cancel_refund", "plan_or_premium_management", "content_missing_or_metadata",
    "device_integration_issue", "app_bug_or_crash", "feature_request_or_complaint", "praise_or_chitchat", "other",
]
ESCALATION_CODES = [
    "billing_dispute", "suspected_account_compromise", "refund_request", "legal_privacy_data_request", "explicit_cancellation_threat", "abusive_or_distressed_language",
    "requires_account_specific_pii", "troubleshooting_already_failed", "low_model_confidence", "no_retrieval_support",
]
AUTO_CODES = ["known_troubleshooting_flow", "informational_answer", "chitchat_or_praise"]
COST_MISSED, COST_NEEDLESS = 10.0, 1.0
RRF_K, TOP_N, TOP_K, REPLY_CHARS = 60, 8, 3, 280
TARGET, FLOOR, HARD_QUOTA = 220, 12, 0.15
#: Replies that are fixed values: the one of the trivial baseline and the one where drafting failed.
CANNED = "Hey there! Sorry about the trouble. Try logging out and back in, and let us know how it goes /AI"
HANDED_ON = "Hey there! We want to get this sorted properly - we're passing you to a teammate who can dig into it. /AI"
MUST_STOP = "the a an to of for and or is in on with that".split()
CLUSTER_INTENT = {
    "content_availability_issue": "content_missing_or_metadata", "album_availability_request": "content_missing_or_metadata", "music_feature_requests": "content_missing_or_metadata",
    "service_availability_request": "feature_request_or_complaint", "app_update_request": "feature_request_or_complaint", "playlist_management_requests": "feature_request_or_complaint",
    "account_upgrade_issue": "plan_or_premium_management", "music_playback_issues": "playback_streaming_issue", "service_access_issue": "other",
}
PRICES = {"nano": (0.15, 0.60), "mini": (0.40, 1.60), "lite": (0.10, 0.40), "full": (2.50, 10.00)}
