"""Fixed values of the morphology policy: rules, patterns, phenotypes and confidence ranks."""

from __future__ import annotations

# (name, target, language, phenotype, pattern, exclusions)
DIRECT_RULES = (
    ("effusion_en_plural", "Effusion", "english", "joint_effusion", r"\b(?:joint\s+)?effusions?\b", ()),
    ("effusion_tr_root", "Effusion", "turkish", "joint_effusion", r"\b(?:efuzyon\w*|eklem.{0,35}sivi\w*(?:\s+(?:miktar\w*|artis\w*|fazlalig\w*))?)", ()),
    ("effusion_de_root", "Effusion", "german", "joint_effusion", r"\b(?:gelenkerguss\w*|ergussbildung\w*)", ()),
    ("effusion_el_root", "Effusion", "greek_script", "joint_effusion", r"\b(?:υδραρθρ\w*|ενδ\w*.{0,30}υγρ\w*)", ()),
    ("baker_variants", "Baker's", "english", "baker_cyst", r"\bbaker\w*.{0,20}(?:cyst\w*|kist\w*|zyst\w*|quiste\w*|cista\w*)", ()),
    ("baker_sl", "Baker's", "south_slavic", "baker_cyst", r"\bbaker\w*.{0,15}cist\w*", ()),
    ("baker_nl", "Baker's", "dutch", "baker_cyst", r"\bbaker(?:se|s)?\s+cyst\w*", ()),
    ("baker_el", "Baker's", "greek_script", "baker_cyst", r"(?:κυστ\w*.{0,20}baker|baker.{0,20}κυστ\w*)", ()),
    ("synovitis_de", "Synovitis", "german", "synovitis", r"\b(?:synovit\w*|synovial\w*.{0,45}(?:hypertroph\w*|verdick\w*|prolifer\w*))", ("tenosynov", "zyst", "plica",)),
    ("synovitis_el", "Synovitis", "greek_script", "synovitis", r"\b(?:υμενιτ\w*|παχυν\w*.{0,60}υμεν\w*)", ("κυστ", "πτυχ",)),
    ("synovitis_sl", "Synovitis", "south_slavic", "synovitis", r"\b(?:sinovit\w*|sinovij\w*.{0,45}(?:hipertrof\w*|zadeblj\w*))", ("cista", "plika",)),
    ("synovitis_tr", "Synovitis", "turkish", "synovitis", r"\b(?:sinovit\w*|snovit\w*|sinov\w*.{0,45}(?:kalinla\w*|hipertrof\w*))", ("kist", "plika",)),
    ("contusion_en", "Contusion", "english", "bone_contusion", r"\b(?:bone\s+bruis\w*|osseous\s+contusion\w*|bone\s+contusion\w*)", ()),
    ("contusion_tr", "Contusion", "turkish", "bone_contusion", r"\bkontuz\w*", ()),
    ("contusion_sl", "Contusion", "south_slavic", "bone_contusion", r"\b(?:kontuz\w*|nagnjec\w*)", ()),
    ("contusion_el", "Contusion", "greek_script", "bone_contusion", r"\b(?:οστικ\w+.{0,30})?(?:θλασ\w*|μωλωπ\w*)", ()),
    ("contusion_cyr", "Contusion", "cyrillic_script", "bone_contusion", r"\b(?:костн\w+.{0,30})?(?:контуз\w*|ушиб\w*)", ()),
    ("fracture_en", "Fracture", "english", "fracture", r"\bfractur\w*", ()),
    ("fracture_de", "Fracture", "german", "fracture", r"\bfraktur\w*", ()),
    ("fracture_fr", "Fracture", "french", "fracture", r"\bfractur\w*", ()),
    ("fracture_tr", "Fracture", "turkish", "fracture", r"\b(?:kirik\w*|fraktur\w*)", ()),
    ("fracture_sl", "Fracture", "south_slavic", "fracture", r"\b(?:fraktur\w*|prijelom\w*|prelom\w*)", ()),
    ("fracture_el", "Fracture", "greek_script", "fracture", r"\bκαταγ\w*", ()),
    ("fracture_cyr", "Fracture", "cyrillic_script", "fracture", r"\b(?:фрактур\w*|счуп\w*|перелом\w*)", ()),
)

OA_ANATOMY_PATTERNS = {
    "Medial OA": r"(?:\bmedial\w*.{0,35}(?:compart\w*|femorotib\w*|tibiofem\w*)|\bmediaal\w*.{0,35}(?:compartiment\w*|femorotibiaal\w*)|\bmedijaln\w*.{0,35}(?:kompartment\w*|femorotibijal\w*)|\bmed(?:ial|yal)\w*.{0,35}(?:kompartman\w*|femorotibyal\w*)|εσω.{0,35}(?:διαμερισμ|κνημομηριαι)|медиал\w*.{0,35}(?:компарт\w*|отдел\w*))",
    "Lateral OA": r"(?:\blateral\w*.{0,35}(?:compart\w*|femorotib\w*|tibiofem\w*)|\blateraal\w*.{0,35}(?:compartiment\w*|femorotibiaal\w*)|\blateraln\w*.{0,35}(?:kompartment\w*|femorotibijal\w*)|\blateral\w*.{0,35}(?:kompartman\w*|femorotibyal\w*)|εξω.{0,35}(?:διαμερισμ|κνημομηριαι)|латерал\w*.{0,35}(?:компарт\w*|отдел\w*))",
    "PF OA": r"(?:\bpatell?o?femoral\w*|\bfemoropatel\w*|\bretropatel\w*|\btrochle\w*|\bpatell?ar?\w*.{0,30}(?:cartilage\w*|kikirdak\w*|knorpel\w*|kraakbeen\w*)|\b(?:cartilag|hrskavic)\w*.{0,30}patel\w*|επιγονατιδομηριαι|χονδρ\w*.{0,30}επιγονατ\w*|пателофемор\w*|ретропател\w*|хрущял\w*.{0,30}пател\w*)",
}

OA_PATHOLOGY_PATTERN = r"(?:\bosteoarthr\w*|\barthros\w*|\bartroz\w*|\bgonartroz\w*|\bchondr(?:osis|opath\w*|omal\w*)|\bcondr(?:osis|opat\w*|omal\w*)|\bhondr(?:opat\w*|omal\w*)|\bkondr(?:opat\w*|omal\w*)|(?:cartilage|chondral|cartilag|condral|kraakbeen|knorpel|hrskavic|kikirdak)\w*.{0,35}(?:loss|defect|fissur|thinn|denud|perd|desgast|lesion|adelgaz|ulcer|verlies|schaden|ausdunn|stanjen|reduc|ostec|kayb|incel)|\bosteophyt\w*|\bosteofit\w*|\bosteofyt\w*|οστεοαρθρ\w*|χονδρο(?:παθ|μαλακ)\w*|(?:λεπτυν|απωλε|διαβρ)\w*.{0,30}χονδρ\w*|остеоартр\w*|артроз\w*|хондро(?:пат|малац)\w*|хрущял\w*.{0,35}(?:дефект|изтън|износ|редуц)\w*)"

STRUCTURAL_ANATOMY_ROOTS = {
    "ACL": r"(?:\bacl\b|\blca\b|anterior cruciate ligament|ligamento cruzado anterior|on capraz bag\w*|prednj\w*.{0,20}(?:krizn|ukrsten)\w*.{0,20}ligament\w*)",
    "MCL": r"(?:\bmcl\b|\blcm\b|medial collateral ligament|ligamento colateral medial|medial kollateral ligam\w*|ic yan bag\w*|medijaln\w*.{0,20}kolateraln\w*.{0,20}ligament\w*)",
    "Medial Meniscus": r"(?:medial menisc\w*|menisco (?:medial|interno)|menisque (?:medial|interne)|innenmenisk\w*|medyal menisk\w*|medijaln\w+ men(?:isk|sik)\w*)",
    "Lateral Meniscus": r"(?:lateral menisc\w*|menisco (?:lateral|externo)|menisque (?:lateral|externe)|aussenmenisk\w*|lateral menisk\w*|lateraln\w+ menisk\w*)",
}

LIGAMENT_PATHOLOGY_PATTERN = r"\b(?:tear\w*|torn|ruptur\w*|sprain\w*|injur\w*|avulsion\w*|degener\w*|mucoid\w*|lesion\w*|rotur\w*|desgarr\w*|esguince\w*|yirtik\w*|dejener\w*|lezij\w*|puknuc\w*|ozljed\w*)"

MENISCUS_PATHOLOGY_PATTERN = LIGAMENT_PATHOLOGY_PATTERN + r"|\b(?:macerat\w*|extrus\w*|extrud\w*|blunt\w*|fray\w*|meniskopat\w*)"

NORMAL_PATTERN = r"\b(?:normal\w*|intact\w*|preserv\w*|unremarkable|conservad\w*|integr\w*|sin alteraciones|normaal\w*|regelrecht\w*|unauffallig\w*|intakt\w*|dogal\w*|korunmus\w*|ured\w*|ocuvan\w*|odrzan\w*|primjeren\w*)"

CARTILAGE_PATTERN = r"(?:cartilage|chondral|cartilag|condral|kraakbeen|knorpel|hrskavic|kikirdak|χονδρ|хрущ)"

LOCATIVE_MCL_EXCLUSION = r"\b(?:(?:adjacent to|deep to|beneath|under|along|next to|por debajo de|subyacente a)\s+(?:the\s+)?mcl|(?:pod|ispod|uz)\s+mcl)\b"

LOCATIVE_BRIDGE = r"\b(?:adjacent to|abutting|along|around|next to|near|in front of|anterior to|posterior to|deep to|beneath|under|extending to|extension to|por delante de|junto a|adyacente a|uz|pod|ispod|auf die|vor dem|neben)\b"

UNCERTAINTY_PATTERN = r"\b(?:temsil edebilir|uyumlu olabilir|dusundurur|olabilir|pourrait representer|moze odgovarati|mogao bi predstavljati|r o|dd)\b|\?"

PHENOTYPE_PATTERNS = (
    ("avulsion", r"avulsion|avuls\w*"),
    ("fracture", r"fractur|fraktur|kirik|prijelom|prelom|\u03ba\u03b1\u03c4\u03b1\u03b3|\u0444\u0440\u0430\u043a\u0442\u0443\u0440|\u0441\u0447\u0443\u043f|\u043f\u0435\u0440\u0435\u043b\u043e\u043c"),
    ("tear", r"tear|torn|ruptur|rotur|desgarr|yirtik|puknuc|\u03c1\u03b7\u03be|\u0440\u0430\u0437\u043a\u044a\u0441|\u0441\u043a\u044a\u0441"),
    ("sprain", r"sprain|esguince|zorlan|ozljed|\u03ba\u03b1\u03ba\u03c9\u03c3"),
    ("degeneration", r"degener|dejener|mucoid|mukoid|miksoid|myxoid|meniskopat|ekfy|\u03b5\u03ba\u03c6\u03c5\u03bb|\u0434\u0435\u0433\u0435\u043d\u0435\u0440"),
    ("extrusion", r"extrus|extrud|ekstruz|\u03c5\u03c0\u03b5\u03be\u03b1\u03c1\u03b8\u03c1"),
    ("chondral_abnormality", r"chond|condr|hondr|kondr|cartil|kraakbeen|knorpel|hrskavic|kikirdak|\u03c7\u03bf\u03bd\u03b4\u03c1|\u0445\u043e\u043d\u0434\u0440|\u0445\u0440\u0443\u0449"),
)

CONTINUATION_PATTERN = r"^(?:and|or|with|without|as well as|y|o|con|sin|et|avec|sans|und|oder|mit|ohne|ve|veya|ile|uz|i|te|bez|kao|\u03ba\u03b1\u03b9|\u03c7\u03c9\u03c1\u03b9\u03c2|\u0438|\u0431\u0435\u0437)\b"

CONFIDENCE = {
    "exact_positive": 0.90, "morphology_positive": 0.88, "target_rule_positive": 0.87, "collective_positive": 0.80,
    "exact_negative": 0.85, "morphology_negative": 0.83, "target_rule_negative": 0.82, "collective_negative": 0.75,
    "uncertain": 0.50, "conflict_penalty": 0.18, "unknown": 0.0,
}

DETECTOR_PRIORITY = {"v3_target": 4, "v3_morphology": 3, "v2_exact": 2, "v2_collective": 1}
