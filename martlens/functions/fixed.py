"""Word lists, patterns and tables that results depend on, in their natural order."""

BRANDS = [
    "hp", "dell", "lenovo", "asus", "acer", "msi", "apple", "samsung", "lg", "microsoft", "razer", "alienware",
    "gigabyte", "corsair", "logitech", "sony", "toshiba", "huawei", "xiaomi", "oneplus", "intel", "amd", "nvidia",
    "seagate", "western digital", "wd", "kingston", "sandisk", "crucial", "hyperx", "benq", "viewsonic", "philips",
    "aoc", "adata", "cooler master", "thermaltake", "nzxt", "evga", "zotac", "palit", "gainward", "pny", "galax",
    "asrock", "biostar", "sapphire", "xfx", "powercolor", "his", "club3d", "creative", "trust", "genius", "rapoo",
    "redragon", "steelseries", "roccat", "cougar", "coolermaster", "deepcool", "be quiet", "fractal", "antec",
    "seasonic", "chieftec", "zalman", "enermax", "silverstone",
]

CATEGORY_KEYWORDS = {
    "Laptop": ["laptop", "portable", "notebook", "ultrabook", "chromebook", "netbook", "ordinateur portable"],
    "Desktop": ["desktop", "pc fixe", "tour", "ordinateur de bureau", "unite centrale", "gaming pc", "workstation"],
    "Monitor": ["monitor", "ecran", "display", "screen", "moniteur", "lcd", "led"],
    "Keyboard": ["keyboard", "clavier", "mecanique", "mechanical"],
    "Mouse": ["mouse", "souris", "gaming mouse"],
    "Headset": ["headset", "casque", "headphone", "ecouteur", "earphone", "earbuds"],
    "Webcam": ["webcam", "camera", "web cam"],
    "Processor": ["processor", "processeur", "cpu", "intel core", "ryzen"],
    "Graphics Card": ["gpu", "graphics card", "carte graphique", "video card", "geforce", "radeon", "gtx", "rtx", "rx"],
    "RAM": ["ram", "memory", "memoire", "ddr4", "ddr5", "dimm"],
    "Storage": ["ssd", "hdd", "hard drive", "disque dur", "storage", "nvme", "m.2", "sata"],
    "Motherboard": ["motherboard", "carte mere", "mainboard", "mobo"],
    "Power Supply": ["power supply", "alimentation", "psu", "bloc alimentation"],
    "Case": ["case", "boitier", "tower", "chassis", "boîtier"],
    "Router": ["router", "routeur", "modem", "wifi", "access point"],
    "Printer": ["printer", "imprimante", "multifunction"],
    "Scanner": ["scanner", "scanneur"],
    "Speaker": ["speaker", "enceinte", "haut-parleur", "subwoofer"],
    "Microphone": ["microphone", "micro", "studio mic"],
    "Cable": ["cable", "câble", "hdmi", "usb cable", "displayport"],
    "Adapter": ["adapter", "adaptateur", "dongle"],
    "Charger": ["charger", "chargeur", "ac adapter"],
    "Battery": ["battery", "batterie", "pile", "power bank"],
    "Cooling": ["cooling", "ventilateur", "fan", "refroidissement", "watercooling", "ventirad", "radiator"],
    "UPS": ["ups", "onduleur", "backup power"],
    "Network Card": ["network card", "carte reseau", "ethernet", "wifi card"],
    "Sound Card": ["sound card", "carte son", "audio card"],
    "Tablet": ["tablet", "tablette", "ipad"],
}

PROCESSOR_PATTERNS = [
    r"intel\s+core\s+i[3579](?:-\d{4,5}[A-Z]*)?", r"amd\s+ryzen\s+[3579](?:\s+\d{4}[A-Z]*)?", r"intel\s+celeron(?:\s+\w+)?",
    r"intel\s+pentium(?:\s+\w+)?", r"amd\s+athlon(?:\s+\w+)?", r"apple\s+m[123](?:\s+(?:pro|max|ultra))?", r"intel\s+xeon(?:\s+\w+)?",
    r"amd\s+threadripper(?:\s+\w+)?", r"intel\s+core\s+ultra\s+[579]",
]
RAM_PATTERNS = [
    r"\b(\d+)\s*(?:gb|go)\s*(?:ram|memory|memoire)", r"\bram\s*[:\-]?\s*(\d+)\s*(?:gb|go)", r"\b(\d+)gb\s+ddr[45]",
    r"\bddr[45]\s+(\d+)gb", r"\b(\d+)\s*(?:gb|go)\s+ddr[45]",
]
STORAGE_PATTERNS = [
    r"\b(\d+)\s*(?:gb|go|tb|to)\s*(?:ssd|hdd|nvme|m\.?2)", r"(?:ssd|hdd|nvme)\s*[:\-]?\s*(\d+)\s*(?:gb|go|tb|to)",
    r"\b(\d+)\s*(?:gb|tb)\s*(?:ssd|hdd)", r"\b(\d+)\s*to\s*(?:ssd|hdd)",
]
SCREEN_PATTERNS = [r'(\d{2}(?:\.\d)?)\s*(?:inch|pouces|po|")', r'(\d{2}(?:\.\d)?)\s*(?:")', r"(\d{2}(?:\.\d)?)''"]
SIGNATURE_PROCESSOR = r"(i[3579]|ryzen\s*[3579]|m[123]|celeron|pentium|athlon)"
MODEL_STOPWORDS = [
    "intel", "amd", "nvidia", "with", "avec", "ram", "ssd", "hdd", "gb", "go", "tb", "to", "ddr4", "ddr5", "ghz",
    "core", "ryzen", "geforce", "radeon", "inch", "pouces", "lcd", "led",
]
TITLE_PATTERNS = {
    "processor": [r"(?i)(Intel Core i[3579]-\d+\w*)", r"(?i)(AMD Ryzen [579] \d+\w*)"],
    "gpu": [r"(?i)(RTX \d{4}\s*\w*)", r"(?i)(GTX \d{4}\s*\w*)"],
    "ram_gb": [r"(?i)(\d+)\s*(?:Go|GB)"],
    "storage": [r"(?i)(\d+\s*(?:Go|To|GB|TB))"],
    "screen_size": [r"(\d{2}(?:\.\d)?)[\"']"],
}
#: The same of the third shop, whose titles are French; its storage is an amount and a unit.
LISTED_PATTERNS = {
    "processor": [r"(?i)(Intel Core i[3579]-\d+\w*)", r"(?i)(AMD Ryzen [579] \d+\w*)", r"(?i)(Core i[3579] \d+\w*)", r"(?i)(i[3579]-\d+\w*)"],
    "gpu": [r"(?i)(RTX \d{4}\s*\w*)", r"(?i)(GTX \d{4}\s*\w*)", r"(?i)(Radeon \w+)", r"(?i)(GeForce \w+)", r"(?i)(NVIDIA \w+)"],
    "ram_gb": [r"(?i)(\d+)\s*Go(?:\s+RAM)?"],
    "storage": [r"(?i)(\d+)\s*(Go|To)(?:\s+SSD)?"],
    "screen_size": [r"(\d{2}(?:\.\d)?)[\"']"],
}
BLOCK_INDICATORS = ["cloudflare", "captcha", "access denied", "blocked", "vous avez été bloqué", "unusual traffic", "bot detected"]
FRENCH_WORDS = ["le", "la", "les", "de", "du", "des", "un", "une", "très", "est"]
RATES = {("TND", "EUR"): 0.304, ("EUR", "TND"): 3.29, ("TND", "USD"): 0.32, ("USD", "TND"): 3.12}
CATEGORIES = ["Laptop", "Desktop", "Monitor", "Keyboard", "Mouse", "Headset", "Storage", "Other"]
#: Levels of agreement between the two review models, their weights, and the score from which a review is fake.
ENSEMBLE = {"xgboost": 0.45, "bert": 0.55, "high": 0.1, "medium": 0.3, "fake": 0.5}
#: Words of a small lexicon of opinions in three of the languages that reviews come in, by polarity.
OPINIONS = {
    1.0: ["excellent", "perfect", "amazing", "wonderful", "parfait", "superbe", "magnifique", "perfekt", "ausgezeichnet"],
    0.5: ["good", "great", "nice", "love", "happy", "bon", "bonne", "bien", "content", "gut", "schön", "toll"],
    -0.5: ["bad", "poor", "slow", "sad", "mauvais", "mauvaise", "lent", "mal", "schlecht", "langsam", "leider"],
    -1.0: ["terrible", "awful", "horrible", "worst", "broken", "nul", "nulle", "affreux", "furchtbar", "kaputt"],
}
#: How subjective words of that strength are.
SUBJECTIVITY = {1.0: 0.9, 0.5: 0.6}
#: Words of the same lexicon that turn an opinion round, and that make one stronger or weaker.
NEGATIONS = ["not", "no", "never", "cannot", "without", "don't", "doesn't", "didn't", "isn't", "wasn't", "can't", "won't", "pas", "jamais", "sans", "ni", "nicht", "kein", "keine", "nie", "ohne"]
STRONGER = ["very", "really", "extremely", "so", "too", "absolutely", "très", "vraiment", "tellement", "trop", "sehr", "wirklich", "absolut"]
WEAKER = ["quite", "rather", "slightly", "somewhat", "fairly", "assez", "plutôt", "peu", "ziemlich", "etwas", "eher"]
#: Words that a negation reaches, what is left of a negated opinion, and what each strengthening and weakening word multiplies.
NEGATION_REACH, NEGATED, STRONGER_BY, WEAKER_BY = 3, -0.5, 1.3, 0.5
#: A word, or a mark that ends a sentence.
WORD_OR_END = r"(\p{L}+(?:'\p{L}+)?|[.!?;])"
NOT_FOUND = ["404 Not Found", "Whoops, our bad"]
SHOP_BRAND = r"(?i)^(HP|ASUS|Lenovo|Dell|Acer|MSI|Apple|Samsung|Razer)\b"
#: Review length from which a request is answered, and stages that a model version can be moved to.
SHORTEST_REQUEST, STAGES = 10, ["Staging", "Production", "Archived"]

#: The class of made-up reviews in files of labelled reviews.
FAKE_CODE = "CG"
