"""Fixed values that decide results; everything that can vary is a parameter elsewhere."""

# Words that are no content, in English and Korean.
STOPWORDS_EN = tuple(
    """
    a about above after again against all already also am an and any are as at be because been before being below
    between both but by can cannot could did do does doing down during each few fine for from further had has have
    having he her here hers herself him himself his he's how i i'm i've if in into is it its itself just kids kid
    kind know keep like me more most my myself name no nor not now of off on once one only or other our ours
    ourselves out over own same she should so some sort such than that the their theirs them themselves then there
    these they they're this those through to too under understand until up very was we were what when where which
    while who whom why will with you you've your yours yourself yourselves yeah yes think really maybe probably
    basically actually obviously get got go going gonna wanna want wants that's it's don't you're would true okay
    well guess much thing things another umm um uh interviewee interviewer researcher participant soi andi andthenit
    andthen
    """.split()
)
STOPWORDS_KO = tuple(
    "그리고 그래서 하지만 그러나 저는 제가 우리 때문에 정말 그냥 많이 조금 있는 없는 했습니다 있었습니다 되었습니다".split()
)
STOPWORDS = STOPWORDS_EN + STOPWORDS_KO

# The label that a word suggests.
THEME_HINTS = {
    "peer": "Peer Collaboration",
    "peers": "Peer Collaboration",
    "classmate": "Peer Collaboration",
    "classmates": "Peer Collaboration",
    "community": "Belonging and Course Community",
    "group": "Peer Collaboration",
    "groups": "Peer Collaboration",
    "teacher": "Instructor Support",
    "teachers": "Instructor Support",
    "instructor": "Instructor Support",
    "instructors": "Instructor Support",
    "feedback": "Instructor Support",
    "support": "Instructor Support",
    "supported": "Instructor Support",
    "confidence": "Confidence and Self-Efficacy",
    "confident": "Confidence and Self-Efficacy",
    "isolated": "Isolation and Disconnection",
    "isolation": "Isolation and Disconnection",
    "deadline": "Course Structure and Clarity",
    "deadlines": "Course Structure and Clarity",
    "platform": "Technology and Access Barriers",
    "online": "Online Learning Experience",
    "autonomy": "Learner Autonomy",
    "independent": "Learner Autonomy",
    "motivation": "Motivation and Persistence",
}

# The context that the built-in codebook is meant for.
CONTEXT_TERMS = ("autism", "autistic", "asd", "spectrum")
CONTEXT_PATTERN = r"(?i)\b4[-\s]?h\b"

# Theme colours, used in turn.
THEME_COLORS = (
    "#2563eb", "#dc2626", "#16a34a", "#9333ea", "#ea580c", "#0891b2", "#be123c", "#4f46e5", "#65a30d", "#c2410c",
)

# The built-in codebook. Name; terms; phrases; keywords.
CODEBOOK = (
    (
        "ASD shapes 4-H participation",
        ("autism", "autistic", "asd", "spectrum", "4-h", "4h", "participation", "experience"),
        ("autism spectrum", "on the spectrum", "4-h participation", "participation stressful"),
        ("autism spectrum", "4-H participation", "experience", "stressful"),
    ),
    (
        "Barriers to 4-H participation",
        ("barrier", "barriers", "noise", "crowds", "loud", "unpredictable", "waiting", "line", "harder"),
        ("biggest barrier", "made 4-h participation stressful", "too loud", "talked at once"),
        ("barriers", "participation", "noise", "unpredictability"),
    ),
    (
        "Sensory and transition challenges",
        ("noise", "crowds", "loud", "unpredictable", "transitions", "waiting", "changed", "suddenly"),
        ("noise and crowds", "too loud", "transitions waiting", "plans changed suddenly"),
        ("sensory", "transitions", "unpredictable changes", "crowds"),
    ),
    (
        "Leader training and accommodations",
        ("train", "training", "leaders", "visual", "schedules", "directions", "break", "space", "rules"),
        ("train leaders", "visual schedules", "short directions", "calm break space", "rules ahead"),
        ("leader training", "visual schedules", "break space", "advance rules"),
    ),
    (
        "Useful hands-on 4-H activities",
        ("rabbit", "animals", "project", "hands-on", "cooking", "job", "show", "demonstration"),
        ("rabbit project", "hands-on", "show animals", "cooking club", "short demonstration"),
        ("hands-on activities", "animal projects", "defined jobs", "demonstrations"),
    ),
    (
        "Smaller clubs support inclusion",
        ("small", "smaller", "club", "setting", "predictable", "routine", "fewer", "social", "demands"),
        ("small special interest club", "smaller 4-h setting", "predictable routine", "fewer social demands"),
        ("smaller clubs", "predictable routine", "reduced social demands", "inclusion"),
    ),
    (
        "Gradual involvement builds confidence",
        ("involvement", "watched", "helped", "later", "demonstration", "proud", "teach", "engaged"),
        (
            "involvement changed over time", "watched from the side", "helped set up", "gave a short demonstration",
            "feel proud",
        ),
        ("gradual involvement", "confidence", "demonstration", "teaching others"),
    ),
    (
        "Peer and staff support strategies",
        ("peer", "buddies", "extension", "staff", "support", "checking", "quietly", "explaining", "breaks", "help"),
        ("peer buddies", "extension staff", "checking in quietly", "explaining rules", "take breaks"),
        ("peer buddies", "staff support", "quiet check-ins", "break support"),
    ),
)

# Sentences of results and reports.
REVIEW_STATUS = "Researcher review required"
NOTES = (
    "Researcher review required: generated themes are suggested analytic groupings, not final qualitative findings.",
    "Use exported quotes as evidence candidates and verify meaning against the full transcript context.",
)
CODEBOOK_NOTES = (
    "Contextual coding model used: labels combine transcript context with qualitative code frames.",
    "A quote can appear under more than one suggested theme when it supports multiple analytic codes.",
)
NO_QUOTES_NOTE = "No quote-length text units were found."
VALIDATION_SUMMARY = (
    "Researcher review required: suggested codes and themes must be checked against full transcript context.",
    "Validation checks include evidence count, source coverage, speaker coverage, central-theme alignment, and an explicit review status.",
    "Research basis: thematic analysis is treated as an iterative researcher-led process with traceable quote evidence, not an automated finding generator.",
)
REPORT_WARNING = (
    "These themes and quote matches are machine-generated suggestions. Researchers should verify each quote against "
    "the transcript and revise theme names before reporting findings."
)
