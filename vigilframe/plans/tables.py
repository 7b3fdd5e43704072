"""The pattern tables, word lists and weights of the detectors in operators/detectors.py, as they must be for
their results to be right. Every table is a default; the operators take a caller's own in its place. RE2 and Java read the
patterns alike, but for the few that Spark alone runs."""

#: Few-shot attacks: worked examples, halves of examples, signs of a jailbreak, signs of escalation.
FEWSHOT_ROLES = (r"(?is)(?:User|Human|Person|Prompter)\s*:\s*.+?(?:Assistant|AI|Bot|Claude|ChatGPT|Model)\s*:",)
FEWSHOT_HALVES = (r"(?i)(?:Example|Sample|Demo)\s*\d*\s*:", r"(?i)(?:Input|Question|Prompt)\s*\d*\s*:", r"(?i)(?:Output|Answer|Response)\s*\d*\s*:")
FEWSHOT_JAILBREAK = (
    r"(?i)\b(?:ignore|disregard|forget)\s+(?:your|all|previous|above)\s+(?:instructions|rules|guidelines)\b",
    r"(?i)\b(?:pretend|act as if|imagine|roleplay|you are now)\b",
    r"(?i)\b(?:DAN|jailbreak|bypass|override|unlock)\b",
    r"(?i)\b(?:no restrictions|without restrictions|unrestricted|unfiltered)\b",
    r"(?i)\b(?:evil|devious|malicious)\s+(?:mode|version)\b",
)
FEWSHOT_ESCALATION = (
    r"(?i)\bnow\s+(?:do|tell|show|give|help)\b",
    r"(?i)\b(?:based on|following|using)\s+(?:the\s+)?(?:above|previous)\s+(?:examples?|pattern)\b",
    r"(?i)\b(?:similarly|likewise|in the same way)\b",
    r"(?i)\b(?:continue|keep going|do the same)\b",
)

#: Prompt shield: layer, pattern, attack, confidence.
SHIELD = (
    ("injection", r"(?i)ignore\s+(?:all\s+)?(?:previous|prior|above)\s+(?:instructions?|rules?|guidelines?)", "instruction_override", 0.9),
    ("injection", r"(?i)(?:you\s+are|act\s+as|pretend\s+to\s+be)\s+(?:now|a)\s+", "role_hijack", 0.7),
    ("injection", r"(?i)(?:system|admin)\s*(?:prompt|message|override)\s*[:=]", "system_prompt_injection", 0.9),
    ("injection", r"(?i)do\s+not\s+follow\s+(?:your|any|the)\s+(?:rules|guidelines|instructions)", "rule_bypass", 0.8),
    ("injection", r"(?i)(?:forget|disregard|override)\s+(?:everything|all|your)", "memory_wipe", 0.85),
    ("injection", r"(?i)you\s+(?:must|should|will)\s+(?:now|always)\s+(?:comply|obey|listen)", "authority_assertion", 0.7),
    ("jailbreak", r"(?i)(?:DAN|do\s+anything\s+now)", "DAN_jailbreak", 0.9),
    ("jailbreak", r"(?i)(?:no\s+restrictions|unrestricted\s+mode|developer\s+mode)", "restriction_removal", 0.85),
    ("jailbreak", r"(?i)(?:evil|unethical|immoral)\s+(?:AI|assistant|mode)", "evil_mode", 0.8),
    ("jailbreak", r"(?i)in\s+a\s+(?:fictional|hypothetical)\s+(?:world|scenario|story)\s+where", "fiction_bypass", 0.6),
    ("jailbreak", r"(?i)(?:my\s+)?grandmother\s+(?:used\s+to|would)\s+(?:tell|say|read)", "grandmother_exploit", 0.7),
    ("extraction", r"(?i)(?:show|reveal|display|print|output)\s+(?:your|the)\s+(?:system\s+)?(?:prompt|instructions)", "prompt_extraction", 0.9),
    ("extraction", r"(?i)(?:repeat|echo|copy)\s+(?:everything|all|the\s+text)\s+(?:above|before)", "context_leak", 0.85),
    ("extraction", r"(?i)what\s+(?:are|were)\s+(?:your|the)\s+(?:original\s+)?(?:instructions|rules|guidelines)", "instruction_probe", 0.8),
    ("encoding", r"[\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}]", "zero_width_chars", 0.7),
    ("encoding", r"(?:&#\d{1,5};){3,}", "html_entity_encoding", 0.6),
    ("encoding", r"(?:\\u[0-9a-fA-F]{4}){3,}", "unicode_escape_encoding", 0.6),
    ("encoding", r"(?:%[0-9a-fA-F]{2}){3,}", "url_encoding", 0.5),
    ("encoding", r"(?:[A-Za-z0-9+/]{4}){5,}={0,2}", "base64_encoding", 0.4),
    ("structural", r"(?:Human|User|Assistant)\s*:", "role_delimiter_injection", 0.7),
    ("structural", r"\]\s*\n\s*\[?(?:SYSTEM|INST)", "bracket_injection", 0.8),
    ("structural", r"<\|(?:im_start|im_end|system|user|assistant)\|>", "special_token_injection", 0.9),
    ("structural", r"---+\s*(?:BEGIN|END|SYSTEM)", "separator_injection", 0.6),
)

#: Injection detector: pattern, category, weight; the score from which each sensitivity flags; advice for each category.
INJECTION = (
    (r"(?i)\bignore\s+previous\b", "instruction_override", 1.0),
    (r"(?i)\bdisregard\s+above\b", "instruction_override", 1.0),
    (r"(?i)\bnew\s+instructions\b", "instruction_override", 0.8),
    (r"(?i)\bforget\s+everything\b", "instruction_override", 0.9),
    (r"(?i)\boverride\s+system\b", "instruction_override", 1.0),
    (r"(?i)\byou\s+are\s+now\b", "role_manipulation", 0.9),
    (r"(?i)\bact\s+as\b", "role_manipulation", 0.7),
    (r"(?i)\bpretend\s+to\s+be\b", "role_manipulation", 0.8),
    (r"(?i)\bassume\s+the\s+role\b", "role_manipulation", 0.8),
    (r"(?i)\bswitch\s+to\b", "role_manipulation", 0.6),
    (r"(?i)\bshow\s+me\s+your\s+prompt\b", "system_extraction", 1.0),
    (r"(?i)\bwhat\s+are\s+your\s+instructions\b", "system_extraction", 0.9),
    (r"(?i)\breveal\s+system\b", "system_extraction", 1.0),
    (r"(?i)\boutput\s+your\s+rules\b", "system_extraction", 0.9),
    (r"```system", "delimiter_injection", 0.9),
    (r"###", "delimiter_injection", 0.5),
    (r"<<<", "delimiter_injection", 0.6),
    (r">>>", "delimiter_injection", 0.6),
    (r"\[INST\]", "delimiter_injection", 1.0),
    (r"</s>", "delimiter_injection", 0.9),
    (r"(?i)\bbase64:", "encoding_attack", 0.8),
    (r"(?i)\bhex:", "encoding_attack", 0.7),
    (r"(?i)\brot13:", "encoding_attack", 0.8),
    (r"(?i)unicode\s+escape", "encoding_attack", 0.7),
)
SENSITIVITY = {"low": 0.6, "medium": 0.4, "high": 0.2}
ADVICE = {
    "instruction_override": "Block or sanitize instruction override attempts.",
    "role_manipulation": "Enforce system role boundaries to prevent role hijacking.",
    "system_extraction": "Restrict responses that could leak system prompt content.",
    "delimiter_injection": "Strip or escape special delimiters from user input.",
    "encoding_attack": "Decode and re-scan encoded content before processing.",
}

#: Injection vectors: vector, pattern, weight; look-alike digits and the words that they hide; boundaries; encodings; scripts.
VECTORS = (
    ("instruction_hijack", r"(?i)\bignore\b", 0.7), ("instruction_hijack", r"(?i)\bdisregard\b", 0.8), ("instruction_hijack", r"(?i)\bforget\b", 0.6),
    ("instruction_hijack", r"(?i)\boverride\b", 0.7), ("instruction_hijack", r"(?i)\bnew\s+instructions\b", 0.9), ("instruction_hijack", r"(?i)\binstead\s+of\b", 0.5),
    ("role_manipulation", r"(?i)\byou\s+are\s+now\b", 0.9), ("role_manipulation", r"(?i)\bact\s+as\b", 0.7), ("role_manipulation", r"(?i)\bpretend\s+to\s+be\b", 0.8),
    ("role_manipulation", r"(?i)\bassume\s+the\s+role\b", 0.8), ("role_manipulation", r"(?i)\bswitch\s+persona\b", 0.8),
    ("information_extraction", r"(?i)\bshow\s+me\s+your\s+prompt\b", 1.0), ("information_extraction", r"(?i)\bwhat\s+are\s+your\s+instructions\b", 0.9),
    ("information_extraction", r"(?i)\breveal\b", 0.6), ("information_extraction", r"(?i)\boutput\s+your\s+rules\b", 0.9), ("information_extraction", r"(?i)\bsystem\s+message\b", 0.7),
    ("delimiter_attack", r"```system", 0.9), ("delimiter_attack", r"\[INST\]", 1.0), ("delimiter_attack", r"</s>", 0.9), ("delimiter_attack", r"<<<", 0.7), ("delimiter_attack", r">>>", 0.7),
    ("delimiter_attack", r"---\nsystem:", 0.9), ("delimiter_attack", r"<\|im_start\|>", 0.9), ("delimiter_attack", r"<system>", 0.8), ("delimiter_attack", r"</system>", 0.8),
    ("encoding_evasion", r"(?i)\bbase64\b", 0.7), ("encoding_evasion", r"(?i)\bhex[:\s]", 0.6), ("encoding_evasion", r"(?i)\brot13\b", 0.8),
    ("encoding_evasion", r"(?i)\\u[0-9a-fA-F]{4}", 0.7), ("encoding_evasion", r"(?i)\\x[0-9a-fA-F]{2}", 0.7),
)
VECTOR_LEET = ("013457@$", "oieastas")
VECTOR_LEET_WORDS = ("ignore", "hack", "inject", "override", "bypass", "exploit")
BOUNDARY = r"[\n\r]+|---+|===+|\*{3,}|#{3,}"
ENCODINGS = (r"(?i)\bbase64\b", r"(?i)\bhex[:\s]", r"(?i)\brot13\b", r"(?i)\\u[0-9a-fA-F]{4}", r"(?i)\\x[0-9a-fA-F]{2}", r"(?i)%[0-9a-fA-F]{2}")
FOREIGN = r"[\x{4e00}-\x{9fff}\x{0400}-\x{04ff}\x{0600}-\x{06ff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]"

#: Bias: category, pattern, severity.
BIAS = (
    ("gender", r"(?i)\b(?:women|girls|females?) (?:are|can't|cannot|shouldn't|don't|lack|fail)\b", 0.8),
    ("gender", r"(?i)\b(?:men|boys|males?) (?:are|should) (?:always|naturally|inherently)\b", 0.7),
    ("gender", r"(?i)\b(?:women|girls) (?:belong|should stay|should be)\b", 0.9),
    ("gender", r"(?i)\b(?:man|men|male)(?:'s)? (?:job|work|role|domain)\b", 0.7),
    ("gender", r"(?i)\b(?:typical|like a) (?:woman|girl|man|boy)\b", 0.5),
    ("racial", r"(?i)\b(?:all|most|typical)\s+(?:black|white|asian|hispanic|latino|arab)\s+(?:people|men|women|folks)\b", 0.8),
    ("racial", r"(?i)\b(?:race|ethnic)\s+(?:is|are)\s+(?:superior|inferior|better|worse)\b", 0.95),
    ("racial", r"(?i)\b(?:those|these|their)\s+(?:people|kind|type|sort)\b", 0.4),
    ("age", r"(?i)\b(?:old|elderly) people (?:are|can't|cannot|shouldn't|don't)\b", 0.7),
    ("age", r"(?i)\b(?:young|millennials?|boomers?|gen[- ]?z) (?:are|always|never)\b", 0.6),
    ("age", r"(?i)\btoo old (?:to|for)\b", 0.5),
    ("disability", r"(?i)\b(?:disabled|handicapped) people (?:can't|cannot|shouldn't|are unable)\b", 0.7),
    ("disability", r"(?i)\b(?:suffer from|afflicted|victim of)\s+(?:a |)\w+(?:ism|ity|ness|ia)\b", 0.4),
    ("disability", r"(?i)\b(?:crazy|insane|psycho|retard|lame|dumb)\b", 0.5),
    ("religion", r"(?i)\b(?:all|most|typical)\s+(?:muslims?|christians?|jews?|hindus?|buddhists?)\s+(?:are|believe|want)\b", 0.7),
    ("socioeconomic", r"(?i)\b(?:poor|lower class|uneducated) people (?:are|can't|don't|lack)\b", 0.7),
    ("socioeconomic", r"(?i)\b(?:welfare|homeless) (?:people|folks) (?:are|should|deserve)\b", 0.6),
)

#: Content filter: category, pattern, weight. Misinformation has no pattern.
CONTENT = (
    ("violence", r"(?i)\b(?:kill|murder|slaughter|assassinat|massacr)\w*\b", 0.8),
    ("violence", r"(?i)\b(?:stab|shoot|beat|attack|assault|fight)\w*\b", 0.5),
    ("violence", r"(?i)\b(?:blood|wound|gore|brutal|violent)\w*\b", 0.4),
    ("violence", r"(?i)\b(?:tortur|mutilat|dismember)\w*\b", 0.9),
    ("sexual", r"(?i)\b(?:explicit|pornograph|obscene)\b", 0.7),
    ("sexual", r"(?i)\b(?:nude|naked|strip)\b", 0.5),
    ("hate_speech", r"(?i)\b(?:supremac|inferior race|ethnic cleansing)\b", 0.9),
    ("hate_speech", r"(?i)\b(?:bigot|racist|xenophob|discriminat)\b", 0.4),
    ("self_harm", r"(?i)\b(?:suicide|kill myself|end my life)\b", 0.9),
    ("self_harm", r"(?i)\b(?:self[- ]harm|cut myself|hurt myself)\b", 0.8),
    ("drugs", r"(?i)\b(?:cocaine|heroin|methamphetamine|fentanyl)\b", 0.7),
    ("drugs", r"(?i)\b(?:drug deal|drug traffick|illegal substance)\b", 0.6),
    ("profanity", r"(?i)\b(?:damn|hell|crap)\b", 0.3),
    ("weapons", r"(?i)\b(?:bomb|explosive|grenade|landmine)\b", 0.7),
    ("weapons", r"(?i)\b(?:firearm|rifle|shotgun|ammunition)\b", 0.5),
    ("weapons", r"(?i)\b(?:weapon of mass destruction|chemical weapon|biological weapon)\b", 0.9),
    ("personal_info", r"\b\d{3}[-.]?\d{2}[-.]?\d{4}\b", 0.8),
    ("personal_info", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0.6),
    ("personal_info", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", 0.5),
)

#: Toxicity filter: category, pattern, severity.
TOXIC = (
    ("hate_speech", r"(?i)\b(?:supremac(?:y|ist))\b", 0.9),
    ("hate_speech", r"(?i)\b(?:ethnic cleansing)\b", 0.95),
    ("hate_speech", r"(?i)\b(?:inferior race|master race)\b", 0.9),
    ("hate_speech", r"(?i)\b(?:subhuman|untermensch)\b", 0.85),
    ("hate_speech", r"(?i)\b(?:degenerate|vermin|parasit\w*)\b", 0.6),
    ("hate_speech", r"(?i)\bgo back to (?:your|where)\b", 0.7),
    ("harassment", r"(?i)\byou(?:'re| are) (?:worthless|pathetic|disgusting|useless)\b", 0.7),
    ("harassment", r"(?i)\b(?:nobody (?:likes|loves|cares about) you)\b", 0.7),
    ("harassment", r"(?i)\b(?:shut up|get lost|go away)\b", 0.3),
    ("harassment", r"(?i)\b(?:loser|moron|idiot|stupid)\b", 0.4),
    ("harassment", r"(?i)\b(?:stalking|harassing|bullying)\b", 0.6),
    ("harassment", r"(?i)\byou deserve (?:to suffer|pain|nothing)\b", 0.8),
    ("threats", r"(?i)\bi(?:'ll| will) (?:kill|destroy|hurt|end) you\b", 0.9),
    ("threats", r"(?i)\b(?:death threat|bomb threat)\b", 0.95),
    ("threats", r"(?i)\byou(?:'re| are) (?:dead|done for)\b", 0.7),
    ("threats", r"(?i)\bi(?:'ll| will) (?:find|hunt|track) you\b", 0.8),
    ("threats", r"(?i)\b(?:watch your back|sleep with one eye)\b", 0.7),
    ("threats", r"(?i)\b(?:burn down|blow up)\b", 0.8),
    ("profanity", r"(?i)\b(?:damn|hell|crap)\b", 0.2),
    ("profanity", r"(?i)\b(?:ass|asshole|bastard)\b", 0.4),
    ("profanity", r"(?i)\bf+u+c+k+\w*\b", 0.6),
    ("profanity", r"(?i)\bs+h+i+t+\w*\b", 0.5),
    ("profanity", r"(?i)\bbitch\w*\b", 0.5),
    ("sexual_content", r"(?i)\b(?:explicit sexual|sexual acts?)\b", 0.8),
    ("sexual_content", r"(?i)\b(?:pornograph\w*|obscen\w*)\b", 0.7),
    ("sexual_content", r"(?i)\b(?:nude|naked|strip)\b", 0.4),
    ("sexual_content", r"(?i)\b(?:sexually explicit)\b", 0.8),
    ("sexual_content", r"(?i)\b(?:erotic|lewd|indecent)\b", 0.5),
    ("self_harm", r"(?i)\b(?:kill myself|end my life)\b", 0.95),
    ("self_harm", r"(?i)\b(?:suicide|suicidal)\b", 0.9),
    ("self_harm", r"(?i)\b(?:self[- ]harm|cut myself|hurt myself)\b", 0.85),
    ("self_harm", r"(?i)\b(?:want to die|better off dead)\b", 0.9),
    ("self_harm", r"(?i)\b(?:no reason to live|not worth living)\b", 0.85),
)

#: Sensitivity: level, pattern; the most sensitive level first.
SENSITIVE = (
    ("restricted", r"(?i)\b(?:social\s+security|ssn|tax\s+id)\b"),
    ("restricted", r"(?i)\b(?:credit\s+card|card\s+number|cvv|expir(?:y|ation)\s+date)\b"),
    ("restricted", r"(?i)\b(?:medical\s+record|diagnosis|prescription|patient)\b"),
    ("restricted", r"(?i)\b(?:classified|top\s+secret|security\s+clearance)\b"),
    ("restricted", r"(?i)\b(?:encryption\s+key|private\s+key|master\s+key)\b"),
    ("confidential", r"(?i)\b(?:salary|compensation|bonus|equity|stock\s+option)\b"),
    ("confidential", r"(?i)\b(?:revenue|profit|financial\s+(?:report|statement))\b"),
    ("confidential", r"(?i)\b(?:password|credential|auth(?:entication)?\s+token)\b"),
    ("confidential", r"(?i)\b(?:trade\s+secret|proprietary|intellectual\s+property)\b"),
    ("confidential", r"(?i)\b(?:merger|acquisition|due\s+diligence|term\s+sheet)\b"),
    ("confidential", r"(?i)\b(?:employee\s+(?:record|review|performance))\b"),
    ("internal", r"(?i)\b(?:internal\s+(?:memo|document|policy|meeting))\b"),
    ("internal", r"(?i)\b(?:roadmap|sprint|backlog|release\s+plan)\b"),
    ("internal", r"(?i)\b(?:org\s+chart|team\s+structure|headcount)\b"),
    ("internal", r"(?i)\b(?:vendor|supplier|contract|agreement)\b"),
)

#: Response classes: class, pattern; and how a class is scored: base, step, cap.
RESPONSE = (
    ("refusal", r"(?i)\bI (?:can't|cannot|won't|will not|am (?:not able|unable)) (?:help|assist|provide|do|create|generate)\b"),
    ("refusal", r"(?i)\bI'm (?:not able|unable) to\b"),
    ("refusal", r"(?i)\bI (?:don't|do not) (?:think (?:I should|it's appropriate)|feel comfortable)\b"),
    ("refusal", r"(?i)\bI (?:must|have to) (?:decline|refuse)\b"),
    ("refusal", r"(?i)\bagainst my (?:guidelines|policies|programming)\b"),
    ("refusal", r"(?i)\bAs an AI(?:,| ) I (?:can't|cannot|shouldn't)\b"),
    ("refusal", r"(?i)\bI'?m sorry,? (?:but )?I (?:can't|cannot)\b"),
    ("refusal", r"(?i)\bthat (?:request |)(?:goes against|violates)\b"),
    ("harmful", r"(?i)\bhow to (?:make|build|create) (?:a )?(?:bomb|weapon|explosive)\b"),
    ("harmful", r"(?i)\bstep[- ]by[- ]step (?:guide|instructions?) (?:to|for) (?:hack|attack|exploit)\b"),
    ("harmful", r"(?i)\bhere(?:'s| is) how (?:to|you can) (?:bypass|circumvent|evade)\b"),
    ("harmful", r"(?i)\b(?:kill|murder|harm|hurt) (?:yourself|someone|people)\b"),
    ("error", r"(?i)\b(?:error|exception|traceback|stack trace)\b"),
    ("error", r"(?i)\bsomething went wrong\b"),
    ("error", r"(?i)\binternal (?:server )?error\b"),
    ("error", r"(?i)\b(?:rate limit|quota) (?:exceeded|reached)\b"),
    ("hedging", r"(?i)\bI'?m not (?:entirely |completely )?(?:sure|certain)\b"),
    ("hedging", r"(?i)\bI (?:don't|do not) have (?:access to|information about)\b"),
    ("hedging", r"(?i)\bI (?:should|would) note that\b"),
    ("hedging", r"(?i)\bplease (?:note|be aware|keep in mind)\b"),
    ("hedging", r"(?i)\bit(?:'s| is) important to (?:note|mention|remember)\b"),
    ("hedging", r"(?i)\bI (?:might|may|could) be wrong\b"),
    ("hedging", r"(?i)\bwith (?:the |that )?caveat\b"),
    ("hallucination", r"(?i)\baccording to (?:a |my )(?:recent )?(?:study|research|report) (?:by|from|in) \w+\b"),
    ("hallucination", r"(?i)\b(?:published|released) (?:on|in) (?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2},? 202[5-9]\b"),
    ("hallucination", r"\bDr\.\s+[A-Z][a-z]+ [A-Z][a-z]+ (?:at|from|of) (?:the )?(?:University|Institute|Center)\b"),
)
RESPONSE_SCORES = {"refusal": (0.5, 0.2, 1.0), "harmful": (0.6, 0.2, 1.0), "error": (0.4, 0.2, 1.0), "hedging": (0.3, 0.15, 0.9), "hallucination": (0.3, 0.2, 0.8)}

#: Response safety: signal, pattern. "certain" and "claim" together make the signal hallucination_risk.
SAFETY = (
    ("harmful", r"(?i)\b(?:kill|murder|assassinate|slaughter)\b"),
    ("harmful", r"(?i)\b(?:bomb|explosive|detonate|weapon)\b"),
    ("harmful", r"(?i)\b(?:how to (?:make|build|create) (?:a )?(?:bomb|weapon))\b"),
    ("harmful", r"(?i)\b(?:hate speech|racial slur|ethnic cleansing)\b"),
    ("harmful", r"(?i)\b(?:self[- ]harm|suicide|cut myself)\b"),
    ("harmful", r"(?i)\b(?:illegal drug|synthesize methamphetamine|cook meth)\b"),
    ("harmful", r"(?i)\b(?:hack into|exploit vulnerability|bypass security)\b"),
    ("harmful", r"(?i)\b(?:terrorism|terrorist attack)\b"),
    ("harmful", r"(?i)\b(?:child abuse|human trafficking)\b"),
    ("harmful", r"(?i)\b(?:arson|commit arson)\b"),
    ("leakage", r"\bsk-[a-zA-Z0-9]{20,}\b"),
    ("leakage", r"(?i)\b(?:api[_-]?key|apikey)\s*[:=]\s*\S+"),
    ("leakage", r"(?i)\b(?:password|passwd|pwd)\s*[:=]\s*\S+"),
    ("leakage", r"(?i)\b(?:secret|token)\s*[:=]\s*\S+"),
    ("leakage", r"\b(?:Bearer|Basic)\s+[A-Za-z0-9+/=]{10,}\b"),
    ("leakage", r"(?i)\b(?:system prompt|you are a|your instructions are)\b"),
    ("leakage", r"(?i)\b(?:internal[_-]?url|localhost:\d+|127\.0\.0\.1)\b"),
    ("leakage", r"\bAIza[0-9A-Za-z_-]{35}\b"),
    ("leakage", r"\bghp_[A-Za-z0-9]{36}\b"),
    ("leakage", r"\b(?:ssh-rsa|ssh-ed25519)\s+\S{20,}\b"),
    ("hedging", r"(?i)\bI (?:can't|cannot|won't|am unable to) (?:help|assist|provide)\b"),
    ("hedging", r"(?i)\bI'm not (?:able|allowed) to\b"),
    ("hedging", r"(?i)\bagainst my (?:guidelines|policies|programming)\b"),
    ("hedging", r"(?i)\bI must (?:decline|refuse)\b"),
    ("hedging", r"(?i)\bI'm sorry,? (?:but )?I (?:can't|cannot)\b"),
    ("compliance", r"(?i)\bhere(?:'s| is) how (?:to|you can)\b"),
    ("compliance", r"(?i)\bstep[- ]by[- ]step (?:guide|instructions?)\b"),
    ("compliance", r"(?i)\bsure,? (?:here|I can help)\b"),
    ("toxicity", r"(?i)\bf+u+c+k+\w*\b"),
    ("toxicity", r"(?i)\bs+h+i+t+\w*\b"),
    ("toxicity", r"(?i)\b(?:bitch|asshole|bastard|damn)\b"),
    ("toxicity", r"(?i)\b(?:idiot|moron|stupid|dumb)\b"),
    ("toxicity", r"(?i)\b(?:shut up|go to hell|screw you)\b"),
    ("toxicity", r"(?i)\b(?:die|kill yourself|drop dead)\b"),
    ("toxicity", r"(?i)\b(?:trash|garbage|worthless)\b"),
    ("toxicity", r"(?i)\b(?:disgusting|pathetic|loser)\b"),
    ("bias", r"(?i)\b(?:all (?:men|women|blacks|whites|asians|latinos) (?:are|always|never))\b"),
    ("bias", r"(?i)\b(?:typical (?:man|woman|male|female))\b"),
    ("bias", r"(?i)\b(?:those people|you people|their kind)\b"),
    ("bias", r"(?i)\b(?:old people can't|elderly are|millennials are all|boomers are all)\b"),
    ("bias", r"(?i)\b(?:women(?:'s| )(?:place|role|job) is)\b"),
    ("bias", r"(?i)\b(?:men (?:don't|can't|shouldn't) (?:cry|feel|show emotion))\b"),
    ("bias", r"(?i)\b(?:disabled people (?:can't|are unable|shouldn't))\b"),
    ("bias", r"(?i)\b(?:naturally (?:superior|inferior|better|worse))\b"),
    ("certain", r"(?i)\bdefinitely\b"),
    ("certain", r"(?i)\babsolutely\b"),
    ("certain", r"\b100\s*%\b"),
    ("certain", r"(?i)\bguaranteed\b"),
    ("certain", r"(?i)\bwithout (?:a )?doubt\b"),
    ("certain", r"(?i)\bunquestionabl[ey]\b"),
    ("certain", r"(?i)\balways\b"),
    ("certain", r"(?i)\bnever fails?\b"),
    ("certain", r"(?i)\bproven fact\b"),
    ("certain", r"(?i)\bcertainly\b"),
    ("claim", r"(?i)\b\d{1,3}(?:,\d{3})*(?:\.\d+)?\s*(?:percent|%|million|billion|trillion)\b"),
    ("claim", r"(?i)\b(?:studies? (?:show|prove|confirm|demonstrate))\b"),
    ("claim", r"(?i)\b(?:according to|research (?:shows?|proves?))\b"),
    ("claim", r"\b(?:in (?:19|20)\d{2})\b"),
    ("claim", r"(?i)\b(?:scientists?|experts?|researchers?) (?:have |)(?:found|discovered|confirmed)\b"),
)
SAFETY_WEIGHTS = {"harmful": 2.0, "leakage": 1.5, "compliance": 1.0, "toxicity": 1.0, "bias": 1.0, "hallucination": 1.0}

#: Topic labels and their keywords.
LABELS = {
    "technical": "algorithm api code database function server deploy debug compile runtime",
    "educational": "learn tutorial explain teach study course lesson understand knowledge practice",
    "creative": "story poem imagine fiction novel character narrative metaphor artistic creative",
    "business": "revenue strategy market roi profit growth investor stakeholder budget quarterly",
    "safety": "harmful unsafe injection attack exploit vulnerability malicious threat breach risk",
    "personal": "my i me feel opinion personally believe myself emotion experience",
}

#: Languages: the characters of a script, and frequent words.
SCRIPTS = (
    ("zh", r"\x{4e00}-\x{9fff}"), ("ja", r"\x{3040}-\x{309f}"), ("ja", r"\x{30a0}-\x{30ff}"), ("ko", r"\x{ac00}-\x{d7af}"), ("ar", r"\x{0600}-\x{06ff}"),
    ("hi", r"\x{0900}-\x{097f}"), ("th", r"\x{0e00}-\x{0e7f}"), ("ru", r"\x{0400}-\x{04ff}"), ("el", r"\x{0370}-\x{03ff}"), ("he", r"\x{0590}-\x{05ff}"),
)
LANGUAGE_WORDS = {
    "en": "the is and to of in that it for was are with this have from not but they his she will been would could their which about",
    "fr": "le la les de des du et est un une en que pas pour sur avec dans plus nous sont mais ont aux cette tout",
    "de": "der die das und ist ein eine den dem nicht sich mit auf auch noch wie aber werden haben oder nach sind kann",
    "es": "el la los las de del en que por con una para como pero sus mas este entre cuando muy sin sobre todo desde",
    "pt": "de que em um uma para com por mais como mas dos das foi tem seu sua quando muito nos entre depois sem",
    "it": "di che il la per non una con del della sono anche come dal questo essere stato hanno suo sua loro molto",
    "nl": "de het een van en dat die niet zijn voor met ook maar nog wel naar bij kan meer dan werd heeft",
}

#: Model fingerprints: model, pattern on lower-cased text, weight; and marks of any model.
MODELS = (
    ("claude", r"\bi'd be happy to\b", 0.3), ("claude", r"\blet me\b.*\bbreak\b.*\bdown\b", 0.2), ("claude", r"\bthat's a (?:great|excellent|thoughtful) question\b", 0.2),
    ("claude", r"\bi should note\b", 0.15), ("claude", r"\bi want to be (?:upfront|transparent|honest)\b", 0.2), ("claude", r"\bhowever,? i (?:should|must|need to) (?:note|mention|point out)\b", 0.2),
    ("claude", r"\bi don't have (?:access to|the ability)\b", 0.1), ("claude", r"\bhere's (?:a|my|the) (?:breakdown|summary|analysis)\b", 0.15), ("claude", r"\bi appreciate you\b", 0.15),
    ("claude", r"\blet me know if you'd like\b", 0.15),
    ("gpt", r"\bcertainly[!.]", 0.2), ("gpt", r"\babsolutely[!.]", 0.15), ("gpt", r"\bgreat question[!.]", 0.15), ("gpt", r"\bas an ai\b", 0.3), ("gpt", r"\bi'm just an ai\b", 0.3),
    ("gpt", r"\bmy training data\b", 0.2), ("gpt", r"\bmy knowledge cutoff\b", 0.3), ("gpt", r"\bdelve\b", 0.15), ("gpt", r"\btapestry\b", 0.1), ("gpt", r"\blandscape\b.*\bnavigate\b", 0.1),
    ("gemini", r"\bas a large language model\b", 0.3), ("gemini", r"\bi'm a large language model\b", 0.3), ("gemini", r"\btrained by google\b", 0.3), ("gemini", r"\bhere are some\b.*\bpoints\b", 0.1),
    ("gemini", r"\blet me provide\b", 0.1),
    ("llama", r"\bi'm meta ai\b", 0.3), ("llama", r"\bi cannot provide\b.*\billegal\b", 0.15), ("llama", r"\bnote:\b", 0.05),
)
ANY_MODEL = (
    (r"\bas an ai\b", 0.3), (r"\blanguage model\b", 0.3), (r"\bi don't have (?:feelings|emotions|consciousness)\b", 0.2), (r"\bi was trained\b", 0.2),
    (r"\bhere (?:are|is) (?:a|the) (?:summary|breakdown|list|overview)\b", 0.1), (r"\bhope (?:this|that) helps\b", 0.1), (r"(?:^|\n)\d+\.\s+\*\*", 0.1), (r"(?:^|\n)[-*]\s+\*\*", 0.1),
)

#: Words of harm, each a token without the marks around it.
HARM_WORDS = ("kill", "hack", "exploit", "bomb", "weapon", "attack", "destroy", "illegal")

#: Context boundaries: kind, pattern. Role confusion: name, pattern. Signs of prompt extraction.
BOUNDARIES = (
    ("role_injection", r"(?i)(?:^|\n)\s*system\s*:"), ("role_injection", r"(?i)\[INST\]"), ("role_injection", r"(?i)###\s*System"), ("role_injection", r"(?i)```system"),
    ("role_injection", r"(?i)<\|?system\|?>"), ("role_injection", r"(?i)(?:^|\n)\s*assistant\s*:"), ("role_injection", r"(?i)(?:^|\n)\s*human\s*:"),
    ("boundary_bleed", r"(?i)you\s+must\b"), ("boundary_bleed", r"(?i)your\s+instructions\s+are\b"), ("boundary_bleed", r"(?i)as\s+a\s+system\b"), ("boundary_bleed", r"(?i)your\s+system\s+prompt\b"),
    ("boundary_bleed", r"(?i)you\s+are\s+now\b"), ("boundary_bleed", r"(?i)new\s+instructions\b"), ("boundary_bleed", r"(?i)override\s+(?:your\s+)?instructions\b"),
    ("privilege_escalation", r"(?i)admin\s+mode"), ("privilege_escalation", r"(?i)debug\s+mode"), ("privilege_escalation", r"(?i)developer\s+(?:mode|override)"), ("privilege_escalation", r"(?i)sudo\s+mode"),
    ("privilege_escalation", r"(?i)root\s+access"), ("privilege_escalation", r"(?i)maintenance\s+mode"), ("privilege_escalation", r"(?i)god\s+mode"), ("privilege_escalation", r"(?i)unrestricted\s+mode"),
)
CONFUSION = (
    ("ignore previous", r"(?i)ignore\s+previous"), ("you are now", r"(?i)you\s+are\s+now"), ("act as", r"(?i)act\s+as"), ("pretend you", r"(?i)pretend\s+you"),
    ("new instructions", r"(?i)new\s+instructions"), ("system:", r"(?i)(?:^|\s)system\s*:"), ("assistant:", r"(?i)(?:^|\s)assistant\s*:"), ("forget everything", r"(?i)forget\s+everything"),
)
EXTRACTION_SIGNS = ("system prompt", "system message", "your instructions", "your rules", "your guidelines", "reveal your")

#: Threat feed: id, category, severity (4 critical to 1 low), tags, pattern on lower-cased text.
THREATS = (
    ("PI-001", "prompt_injection", 4, "direct override common", r"(?i)ignore\s+(all\s+)?((previous|prior|above|system)\s+)+(instructions|prompts|rules)"),
    ("PI-002", "prompt_injection", 4, "extraction prompt_leak", r"(?i)(reveal|show|display|print|output|repeat)\s+(\w+\s+)*(system\s*prompt|instructions|initial\s*prompt)"),
    ("PI-003", "prompt_injection", 3, "role persona", r"(?i)you\s+are\s+(now|actually|really)\s+(a|an|my)\s+\w+"),
    ("PI-004", "prompt_injection", 3, "delimiter chatml", r"(?i)(\[INST\]|\[/INST\]|<\|im_start\|>|<\|im_end\|>|<<SYS>>|<</SYS>>)"),
    ("PI-005", "prompt_injection", 2, "context overflow", r"(?i)(repeat|write|output)\s+(the\s+)?(word|letter|phrase)\s+.{1,20}\s+\d{3,}\s+times"),
    ("PI-006", "prompt_injection", 3, "boundary confusion", r"(?i)(end\s+of\s+(conversation|session|chat)|new\s+conversation\s*:?|---\s*system\s*:)"),
    ("JB-001", "jailbreak", 4, "dan persona_jailbreak", r"(?i)\bDAN\b.*?(do\s+anything|no\s+restrictions|unrestricted)"),
    ("JB-002", "jailbreak", 4, "privilege mode_switch", r"(?i)(developer|debug|admin|maintenance|test)\s*mode\s*(enabled|activated|on)"),
    ("JB-003", "jailbreak", 2, "framing hypothetical", r"(?i)(hypothetically|in\s+a\s+fictional|imagine\s+you\s+are|for\s+a\s+novel|in\s+a\s+movie)[,;:\s]+.{0,30}(how\s+(to|would)|what\s+would)"),
    ("JB-004", "jailbreak", 2, "inversion opposite", r"(?i)(opposite\s+day|reversed?\s+mode|do\s+the\s+opposite)"),
    ("DE-001", "data_exfiltration", 4, "data_theft extraction", r"(?i)(output|write|show|display)\s+(\w+\s+)*(training\s+data|user\s+data|private\s+data|confidential)"),
    ("DE-002", "data_exfiltration", 3, "encoding covert", r"(?i)(encode|convert|transform)\s+.{0,30}\s+(base64|hex|binary|rot13)"),
    ("DE-003", "data_exfiltration", 3, "markdown url_exfil", r"(?i)!\[.*\]\(https?://.*\?.*=(data|secret|key|token)"),
    ("MM-001", "model_manipulation", 3, "authority impersonation", r"(?i)i\s+am\s+(your|the|a)\s+(developer|admin|creator|owner|anthropic|openai)\b"),
    ("MM-002", "model_manipulation", 3, "capability unlock", r"(?i)(unlock|enable|activate)\s+(your\s+)?(hidden|secret|true|full)\s+(capabilities|potential|powers|mode)"),
    ("MM-003", "model_manipulation", 2, "emotional social_engineering", r"(?i)(please|i\s+beg\s+you|it's\s+urgent|life\s+or\s+death|emergency).{0,30}(need|must|have\s+to)\s+.{0,30}(ignore|bypass|override)"),
    ("PE-001", "privilege_escalation", 4, "system privilege", r"(?i)(sudo\s+|chmod\s+[0-7]*7|/etc/sudoers|su\s+-\s+root|passwd\s+root)"),
    ("PE-002", "privilege_escalation", 4, "api credential", r"(?i)(admin|root|master)\s*(api[_\s-]?key|token|secret|password)"),
    ("SE-001", "social_engineering", 2, "pretext trust", r"(?i)(i'm\s+a\s+security\s+researcher|authorized\s+penetration\s+test|i\s+have\s+permission)"),
    ("EV-001", "evasion", 3, "unicode homoglyph", r"[\x{0430}-\x{044f}\x{0410}-\x{042f}\x{0391}-\x{03c9}]"),
    ("EV-002", "evasion", 3, "unicode zero_width", r"[\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}]"),
    ("EV-003", "evasion", 2, "leetspeak substitution", r"(?i)[1l][gq][n|\\/][o0][r|2][e3]"),
    ("EV-004", "evasion", 3, "encoding obfuscation", r"(?i)(decode|translate|interpret)\s+(this\s+)?(base64|rot13|hex)\s*:"),
    ("EV-005", "evasion", 2, "multilingual language_switch", r"(responde\s+en|antworte\s+auf|répondez\s+en|отвечай\s+на)"),
    ("RA-001", "resource_abuse", 2, "resource dos", r"(?i)(write|generate|output|create)\s+(a\s+)?\d{4,}\s+(word|character|page|line)"),
    ("RA-002", "resource_abuse", 1, "recursive loop", r"(?i)(take\s+your\s+output|use\s+your\s+response)\s+.{0,20}\s+(as\s+input|and\s+repeat|again)"),
)

#: Threat indicators that count fully in the case given, and less in another: id, type, severity, pattern.
INDICATORS = (
    ("builtin-001", "injection", 4, r"ignore\s+(all\s+)?previous\s+instructions"),
    ("builtin-002", "exfiltration", 3, r"system\s+prompt"),
    ("builtin-003", "evasion", 2, r"base64\s+decode"),
    ("builtin-004", "injection", 3, r"\[INST\]"),
    ("builtin-005", "manipulation", 4, r"jailbreak"),
    ("builtin-006", "manipulation", 4, r"DAN\s+mode"),
    ("builtin-007", "manipulation", 3, r"developer\s+mode"),
    ("builtin-008", "manipulation", 3, r"sudo\s+mode"),
    ("builtin-009", "manipulation", 2, r"repeat\s+after\s+me"),
    ("builtin-010", "evasion", 2, r"translate\s+to\s+(base64|hex|binary|rot13)"),
)

#: Data classes: class, kind, risk (4 critical to 2 medium), regulations, pattern.
DATA = (
    ("financial", "credit_card", 4, "PCI-DSS", r"\b(?:4\d{3}|5[1-5]\d{2}|3[47]\d{2}|6(?:011|5\d{2}))[- ]?\d{4}[- ]?\d{4}[- ]?\d{3,4}\b"),
    ("financial", "bank_account", 3, "GLBA,SOX", r"(?i)\b(?:account\s*(?:number|#|no\.?)\s*:?\s*)\d{8,17}\b"),
    ("financial", "routing_number", 3, "GLBA", r"(?i)\b(?:routing\s*(?:number|#|no\.?)\s*:?\s*)\d{9}\b"),
    ("financial", "iban", 3, "PCI-DSS,GDPR", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}(?:[A-Z0-9]{0,16})\b"),
    ("financial", "swift_code", 2, "GLBA", r"\b[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b"),
    ("health", "medical_record_number", 4, "HIPAA", r"(?i)\b(?:MRN|medical\s*record\s*(?:number|#|no\.?))\s*:?\s*\d{4,10}\b"),
    ("health", "diagnosis_code", 3, "HIPAA", r"(?i)\b(?:ICD[- ]?10[- ]?(?:CM|PCS)?)\s*:?\s*[A-Z]\d{2}(?:\.\d{1,4})?\b"),
    ("health", "npi_number", 3, "HIPAA", r"(?i)\b(?:NPI)\s*:?\s*\d{10}\b"),
    ("health", "health_condition", 3, "HIPAA,HITECH", r"(?i)\b(?:diagnosed?\s+with|patient\s+has|suffering\s+from|treatment\s+for)\s+[A-Za-z\s]{3,40}\b"),
    ("health", "prescription", 3, "HIPAA", r"(?i)\b(?:prescribed?|medication|dosage|rx)\s*:?\s*[A-Za-z]+\s+\d+\s*(?:mg|ml|mcg|units?)\b"),
    ("personal", "ssn", 4, "GDPR,CCPA,PIPEDA", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("personal", "date_of_birth", 3, "GDPR,CCPA,HIPAA", r"(?i)\b(?:DOB|date\s*of\s*birth|born\s*(?:on)?)\s*:?\s*(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\w+\s+\d{1,2},?\s+\d{4})\b"),
    ("personal", "passport", 4, "GDPR,CCPA", r"(?i)\b(?:passport\s*(?:number|#|no\.?))\s*:?\s*[A-Z0-9]{6,9}\b"),
    ("personal", "drivers_license", 3, "GDPR,CCPA", r"(?i)\b(?:driver'?s?\s*licen[sc]e\s*(?:number|#|no\.?))\s*:?\s*[A-Z0-9]{5,15}\b"),
    ("personal", "national_id", 3, "GDPR", r"(?i)\b(?:national\s*id|citizen\s*id|ID\s*number)\s*:?\s*[A-Z0-9]{6,15}\b"),
    ("personal", "biometric", 4, "GDPR,BIPA,CCPA", r"(?i)\b(?:fingerprint|retina|iris|facial\s*recognition|biometric)\s+(?:data|scan|template|hash)\b"),
    ("legal", "attorney_client", 3, "Attorney-Client Privilege", r"(?i)\b(?:attorney[- ]client\s*privilege|privileged\s*(?:and\s*)?confidential|legal\s*privilege|work\s*product\s*doctrine)\b"),
    ("legal", "trade_secret", 3, "DTSA,UTSA", r"(?i)\b(?:trade\s*secret|proprietary\s*(?:information|formula|process)|confidential\s*(?:business|intellectual)\s*property)\b"),
    ("legal", "nda_content", 2, "Contract Law", r"(?i)\b(?:non[- ]?disclosure\s*agreement|NDA|confidentiality\s*agreement)\b"),
    ("government", "classification_marking", 4, "EO 13526", r"(?i)\b(?:TOP\s*SECRET|SECRET|CONFIDENTIAL|RESTRICTED|UNCLASSIFIED)[/\\]+(?:NOFORN|REL\s*TO|ORCON|SCI)\b"),
    ("government", "export_controlled", 4, "ITAR,EAR", r"(?i)\b(?:ITAR|EAR|export[- ]controlled|ECCN\s*\d[A-Z]\d{3})\b"),
)

#: Code execution: modules by severity; calls and resources: pattern, severity; any other language: pattern, severity.
IMPORTS = (
    ("critical", "subprocess shutil ctypes multiprocessing"),
    ("high", "socket http urllib requests httpx ftplib smtplib telnetlib pickle shelve marshal"),
    ("medium", "threading asyncio signal sqlite3 csv"),
)
CALLS = (
    ("dangerous_call", r"\bos\.system\s*\(", "critical"), ("dangerous_call", r"\bos\.popen\s*\(", "critical"), ("dangerous_call", r"\bos\.exec\w*\s*\(", "critical"),
    ("dangerous_call", r"\bos\.spawn\w*\s*\(", "critical"), ("dangerous_call", r"\bos\.remove\s*\(", "high"), ("dangerous_call", r"\bos\.rmdir\s*\(", "high"),
    ("dangerous_call", r"\bos\.unlink\s*\(", "high"), ("dangerous_call", r"\bos\.rename\s*\(", "medium"), ("dangerous_call", r"\bos\.chmod\s*\(", "high"),
    ("dangerous_call", r"\bos\.environ\b", "medium"), ("dangerous_call", r"\bsubprocess\.\w+\s*\(", "critical"), ("dangerous_call", r"\beval\s*\(", "critical"),
    ("dangerous_call", r"\bexec\s*\(", "critical"), ("dangerous_call", r"\bcompile\s*\(", "high"), ("dangerous_call", r"\b__import__\s*\(", "high"),
    ("dangerous_call", r"\bgetattr\s*\(", "medium"), ("dangerous_call", r"\bsetattr\s*\(", "medium"), ("dangerous_call", r"\bopen\s*\([^)]*[\"']w", "high"),
    ("dangerous_call", r"\bopen\s*\([^)]*[\"']a", "high"), ("dangerous_call", r"\bglobals\s*\(\s*\)", "medium"), ("dangerous_call", r"\bsys\.exit\s*\(", "high"),
    ("dangerous_call", r"\bexit\s*\(\s*\)", "medium"), ("resource_exhaustion", r"while\s+True\s*:", "high"), ("resource_exhaustion", r"for\s+\w+\s+in\s+range\s*\(\s*\d{8,}", "high"),
    ("resource_exhaustion", r"\*\s*\d{6,}", "medium"), ("resource_exhaustion", r"recursion|sys\.setrecursionlimit", "medium"),
)
GENERIC_CALLS = (
    ("generic_danger", r"(?i)\bsystem\s*\(", "critical"), ("generic_danger", r"(?i)\bexec\s*\(", "critical"), ("generic_danger", r"(?i)\beval\s*\(", "critical"),
    ("generic_danger", r"(?i)\brm\s+-rf\b", "critical"), ("generic_danger", r"(?i)\bformat\s+[cC]\b", "critical"), ("generic_danger", r"(?i)\b(?:curl|wget)\s+", "high"),
)
SEVERITY_WEIGHTS = {"critical": 1.0, "high": 0.7, "medium": 0.3, "low": 0.1}
