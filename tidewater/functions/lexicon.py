"""Word lists, tables and patterns that results depend on."""

# Words of a text: runs of letters and digits, with apostrophes inside. Java and RE2 need the
# classes spelled out; Python's [^\W_] is the same set.
WORD_JVM = "[\\p{L}\\p{N}]+(?:['’][\\p{L}\\p{N}]+)*"
WORD_PY = r"[^\W_]+(?:['’][^\W_]+)*"

# Corpus preparation.
NEGATION = "no not never neither nor without don't dont won't wont can't cant".split()
UNCERTAINTY = "may might could maybe perhaps possibly probably likely unlikely think guess unsure uncertain".split()
FILLERS = "uh um uhm er ah".split()
CALENDAR = (
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august "
    "september october november december"
).split()

# Guard of model output; these lists differ from the ones above on purpose.
GUARD_FILLERS = "uh um er erm".split()
GUARD_DISCOURSE = "well okay ok anyway basically".split()
GUARD_NEGATION = (
    "no not never neither nor without unless cannot can't don't doesn't didn't won't wouldn't shouldn't isn't aren't"
).split()
GUARD_UNCERTAINTY = "think believe maybe perhaps probably possibly uncertain unsure seems seem guess roughly approximately".split()
GUARD_GRAMMAR = "a an the and or but that this it is are was were be been being to of for on in at by with then".split()
GUARD_INTENT = (
    "what when where why how who which can could would will should do does did are is send write explain run set remind "
    "call install turn record open close create delete make schedule tell show list draft email text output"
).split()
GUARD_IMPERATIVE = (
    "send write explain run set remind call install turn record open close create delete make schedule tell show list "
    "draft email text output archive keep deploy"
).split()
GUARD_LEADING = "please first next then".split()
GUARD_META = ("the speaker ", "the transcript ", "this transcript ", "the user ", "it sounds like ", "the task is ")
GUARD_ANSWERS = (
    "sure,", "certainly", "of course", "i can help", "i'll make sure", "i will make sure", "please wait while", "here is", "here's",
)
GUARD_PREFIXES = (
    "The cleaned transcript is:", "Cleaned transcript:", "The cleaned text is:", "Cleaned text:", "The corrected text is:", "Corrected text:",
)
GUARD_SUFFIXES = ("END QUOTED TEXT", "EDIT:", "</dictation>", "</transcript_data>")
# What the guard of a device strips.
RUNTIME_PREFIXES = ("Cleaned transcript:", "Cleaned text:", "Output:")
RUNTIME_SUFFIXES = ("<|im_end|>", "<|endoftext|>", "<|eot_id|>")
GUARD_LEFT = "\"'“”([{,;!?"
GUARD_RIGHT = "\"'“”)]},;!?."
NUMBERS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18,
    "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
    "hundred": 100, "thousand": 1000, "million": 10**6, "billion": 10**9,
    "first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10,
    "eleventh": 11, "twelfth": 12,
}
TIME_CUES = "at before after around by until from about".split()
TIME_SUFFIXES = ("am", "pm", "a.m", "p.m")

# Limits of the guard: at least 3/10 and at most 9/5 of the input's length, 65 % of the words
# of a question or command.
GUARD_SHORTEST, GUARD_LONGEST, GUARD_RETAINED = (3, 10), (9, 5), 65

# Reasons of the guard.
REASON = {
    "empty": "Model returned empty text",
    "cap": "Model reached the output token limit",
    "meta": "Model summarized or described the dictation",
    "answer": "Model answered or acted on the dictation",
    "short": "Model output was suspiciously shorter than the input",
    "long": "Model output exceeded the conservative expansion limit",
    "novel": "Model introduced new lexical content: ",
    "dropped": "Model dropped protected lexical content: ",
    "replacement": "Model did not preserve self-correction replacement",
    "superseded": "Model retained superseded self-correction content",
    "intent": "Model did not preserve the dictated intent",
    "content": "Model removed too much question or command content",
}

# Predicates of the classifier; the syntax is that of Java and of RE2.
PATTERNS = {
    "high_stakes": r"(?i)\b(patient|diagnos|dose|medication|legal|lawsuit|plaintiff|tax|liability|investment|financial)\b",
    "adversarial": r"(?i)\b(ignore previous|system:|assistant:|developer:|output only|return json|password|shell command)\b",
    "technical": r"(?i)\b(api|database|server|schema|model|python|kotlin|android|build|deploy|version|release|http|json|sql|gpu|cuda)\b",
    "correction": r"(?i)\b(no(?: sorry)?|wait|actually(?: make that)?|i mean|rather|oops|hold (?:on|up))\b",
    "grammar_cue": r"(?i)\b(?:gonna|wanna|gotta|ain't|aint|should of|could of|would of|me and (?:him|her|them|[a-z]+)|(?:him|her|them) and me)\b",
    "asr_cue": (
        r"(?i)\b(?:post gress|post sequel|cube er nett(?:y|ies)|dock er|red is|jason|java script|web socket|oh auth|pie torch|my sequel|"
        r"react jay ess|node jay ess|type script|tensor flow|git hub|get hub|pie thon)\b"
    ),
    "list_marker": r"(?m)^\s*(?:[-*•]|\d+[.)])\s+",
    "spoken_list": (
        r"(?i)\b(?:one|two|three|four|five|six|seven|eight|nine|ten|first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth)\b"
    ),
    "discourse": r"(?i)\b(?:basically|you know|i mean|kind of|sort of|honestly)\b",
    "command": (
        r"(?i)^\s*(?:please\s+)?(?:send|deploy|call|remind|add|create|delete|remove|run|check|use|schedule|email|text|message|open|close|"
        r"move|copy|save|publish|install|restart|stop|start)\b"
    ),
    "annotation": r"\[[^\]]+\]|\b[^\s*]+\*",
    "version": r"(?i)\bv?\d+(?:\.\d+){1,}(?:[-+][A-Za-z0-9.-]+)?\b",
    "path": r"(?i)(?:https?://\S+|(?:[A-Za-z]:)?[/\\](?:[^\s/\\]+[/\\])*[^\s/\\]+)",
    "identifier": r"(?:\b[A-Z]{2,}[A-Z0-9_-]*\b|\b[a-z]+(?:[A-Z][A-Za-z0-9]*)+\b|\b[a-z][a-z0-9]*_[a-z0-9_]+\b)",
    "money": r"(?i)(?:[$€£¥]\s?\d|\b\d+(?:[.,]\d+)?\s?(?:dollars?|euros?|pounds?|yen)\b)",
    "date_numeric": r"\b\d{4}-\d{2}-\d{2}\b",
    "date_word": (
        r"(?i)\b(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|January|February|March|April|June|July|August|September|"
        r"October|November|December)\b"
    ),
    "date_may": r"(?:\b(?:on|in|by|until|before|after)\s+May\b|\bMay\s+\d{1,2}\b)",
}
SPOKEN_PUNCTUATION = {
    "period": ".", "comma": ",", "colon": ":", "semicolon": ";", "question mark": "?", "exclamation mark": "!", "new line": "\n",
}
# Literals that must survive cleanup.
PROTECTED = (
    r"\b\d+(?:[.,:]\d+)*(?:[-_][\w.]+)*\b",
    r"(?:[A-Za-z]:)?[/\\](?:[^\s/\\]+[/\\])*[^\s/\\]+",
    r"\b[\w.+-]+@[\w.-]+\.\w+\b",
    r"(?i)\b(?:v)?\d+(?:\.\d+)+(?:[-+][A-Za-z0-9.-]+)?\b",
    r"\b[A-Z][A-Za-z0-9]*(?:[A-Z][A-Za-z0-9]*)+\b",
)
# Entities that two tools mask before comparing texts; the tools differ.
ENTITY_GATE = r"(?:\b\d+(?:[.:/-]\d+)*\b|\b[A-Z][\w'-]+\b|\b[\w.+-]+@[\w.-]+\b|(?:^|\s)(?:[/~.]\S+))"
ENTITY_MIXTURE = r"\b(?:[A-Z][\w'-]*|\d+(?:[.:/-]\d+)*|[\w.+-]+@[\w.-]+\.\w+|(?:[A-Za-z]:)?[/\\][^\s]+)\b"

# Labels of upstream data and what they mean here.
UPSTREAM = {
    "self_correction": "self_correction", "false_start": "false_start", "filler_removal": "fillers", "fillers": "fillers",
    "repetition": "repetition", "preserve_wording": "already_clean", "adversarial": "adversarial_instruction",
    "crutch_words": "discourse_marker", "mixed": "mixed", "grammar": "grammar_rewrite", "misheard_words": "asr_correction",
}
FORMATTING = {"dictation_commands": "spoken_punctuation", "list_formatting": "list_formatting", "paragraph_formatting": "paragraph_formatting"}
REVIEWED_UPSTREAM = (
    "crutch_words", "dictation_commands", "list_formatting", "paragraph_formatting", "mixed", "grammar", "misheard_words",
)
LIST_NUMBERS = {
    "0": ("zero",), "1": ("one", "first"), "2": ("two", "second"), "3": ("three", "third"), "4": ("four", "fourth"), "5": ("five", "fifth"),
    "6": ("six", "sixth"), "7": ("seven", "seventh"), "8": ("eight", "eighth"), "9": ("nine", "ninth"), "10": ("ten", "tenth"),
}
