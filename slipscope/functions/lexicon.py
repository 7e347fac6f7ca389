"""Markers that the text features count. Fixed values."""

BOOSTERS = [
    "absolutely", "always", "certainly", "clearly", "definitely", "exactly", "in fact", "indeed", "it is clear that",
    "it is evident that", "never", "no doubt", "obviously", "of course", "precisely", "surely",
    "there is no question", "undoubtedly", "unquestionably", "without doubt", "without question",
]
HEDGES = [
    "approximately", "arguably", "could be", "debatable", "hard to say", "I believe", "I suppose", "I think",
    "I'm not sure", "in some cases", "it appears", "it could be", "it is possible", "it may be", "it might be",
    "it seems", "likely", "maybe", "might", "might suggest", "not entirely clear", "not necessarily", "perhaps",
    "possibly", "potentially", "remains unclear", "roughly", "somewhat", "to some extent", "uncertain", "unlikely",
    "would suggest",
]
DIRECT_EVIDENCE = [
    "according to research", "confirms that", "data shows", "demonstrates that", "evidence indicates",
    "has been shown", "is well documented", "is well established", "proves that", "research demonstrates",
    "studies show",
]
INDIRECT_EVIDENCE = [
    "according to some", "anecdotally", "it has been suggested", "it is said", "preliminary findings", "reportedly",
    "some believe", "some suggest", "there is some evidence",
]
CONCESSIVES = [
    "admittedly", "although", "despite", "granted", "however", "in spite of", "nevertheless", "nonetheless",
    "on the other hand", "while it is true",
]

# Phrases at which a generated answer is cut, in order.
CUTS = ["You are an AI assistant", "You are a helpful assistant", "<|im_end|>", "<|im_start|>", "<|endoftext|>"]
# Cues of a restated answer, openings of an answer, and splitters of a long one, in order.
CUES = ["to provide a concise answer", "in short", "to summarise", "to summarize", "the short answer is", "simply put", "concisely"]
OPENINGS = ["the answer is", "answer:", "a:", "the answer to this question is", "the answer to the question is", "the answer to that is"]
SPLITTERS = [" is ", " was ", " are ", " were "]

# For the rule that finds passives: forms of "be", and participles without "ed" (chosen here).
BE = ["am", "is", "are", "was", "were", "be", "been", "being"]
PARTICIPLES = [
    "begun", "bought", "broken", "brought", "built", "caught", "chosen", "done", "drawn", "driven", "eaten", "fallen",
    "felt", "flown", "forgotten", "found", "given", "gone", "grown", "heard", "held", "hidden", "hit", "kept", "known",
    "laid", "led", "left", "lost", "made", "meant", "met", "paid", "put", "read", "run", "said", "seen", "sent", "set",
    "shown", "sold", "spent", "spoken", "stolen", "taken", "taught", "thought", "thrown", "told", "won", "worn", "written",
]
