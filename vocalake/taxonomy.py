"""Labels, enumerations and small dictionaries the results depend on.

Everything in this module is data. The texts must match the stored labels
character for character, so they are spelled out in their natural order.
"""

# Sentiment enumeration of the classifications table.
POSITIVE = "Positif"
NEGATIVE = "Négatif"
NEUTRAL = "Neutre"
ERROR = "Error"
SENTIMENTS = (POSITIVE, NEGATIVE, NEUTRAL, ERROR)

# Status of a processing run.
PENDING = "pending"
IN_PROGRESS = "in_progress"
COMPLETED = "completed"
FAILED = "failed"
PARTIAL = "partial"

# Flag column -> category label. Order carries meaning:
# 0-6 positive, 7-13 negative, 14 off-topic, 15 other positive, 16 other negative.
CATEGORY_COLUMNS = {
    "cat_accueil_chaleureux": "Accueil chaleureux et personnel attentionné (expérience humaine positive, sentiment d'être bien accueilli)",
    "cat_service_reactif": "Service client réactif et à l'écoute (problèmes résolus rapidement, vraie disponibilité)",
    "cat_conseil_personnalise": "Conseil personnalisé et professionnalisme des équipes (expertise perçue, accompagnement individualisé)",
    "cat_efficacite_rapidite": "Efficacité et rapidité de traitement (fluidité, peu d'attente, processus clairs)",
    "cat_accessibilite_proximite": "Accessibilité et proximité des services (agences, guichets, présence locale, simplicité d'accès)",
    "cat_satisfaction_generale": "Satisfaction sans détails spécifiques (le client indique que le service ou l'agence est bien sans explication )",
    "cat_experience_digitale": "Expérience digitale et services en ligne pratiques (application fluide, opérations faciles à distance )",
    "cat_attente_lenteur": "Attente interminable et lenteur en agence (files d'attente, effectifs insuffisants)",
    "cat_service_injoignable": "Service client injoignable ou non réactif (téléphone, e-mail, promesses de rappel non tenues)",
    "cat_reclamations_ignorees": "Réclamations ignorées ou mal suivies (absence de retour, sentiment d'abandon)",
    "cat_incidents_techniques": "Incidents techniques et erreurs récurrentes (cartes bloquées, pannes système, erreurs de compte)",
    "cat_frais_abusifs": "Frais bancaires jugés abusifs ou non justifiés (perception de déséquilibre prix/service)",
    "cat_insatisfaction_generale": "Insatisfaction sans détails spécifiques (le client indique que le service ou l'agence est nul sans explication )",
    "cat_manque_consideration": "Manque de considération ou attitude peu professionnelle (accueil froid, ton condescendant, sentiment de mépris)",
    "cat_hors_sujet": "Hors-sujet ou contenu non pertinent (ex. « Bon restau », « Je cherche du travail »)",
    "cat_autre_positif": "Autre (positif)",
    "cat_autre_negatif": "Autre (négatif)",
}
FLAG_COLUMNS = tuple(CATEGORY_COLUMNS)
CATEGORIES = tuple(CATEGORY_COLUMNS.values())
OFF_TOPIC = CATEGORY_COLUMNS["cat_hors_sujet"]
OTHER_POSITIVE = CATEGORY_COLUMNS["cat_autre_positif"]
OTHER_NEGATIVE = CATEGORY_COLUMNS["cat_autre_negatif"]

POSITIVE_FLAGS = FLAG_COLUMNS[0:7] + ("cat_autre_positif",)
NEGATIVE_FLAGS = FLAG_COLUMNS[7:14] + ("cat_autre_negatif",)
NEUTRAL_FLAGS = ("cat_hors_sujet",)

# Acceptance threshold and the confidence given to fallback labels.
CONFIDENCE_THRESHOLD = 0.55
FALLBACK_CONFIDENCE = 0.6

# Label prefix -> display name, first match wins.
SHORT_CATEGORY_NAMES = {
    "Accueil chaleureux et personnel attentionné": "Accueil chaleureux",
    "Service client réactif et à l'écoute": "Service réactif",
    "Conseil personnalisé et professionnalisme des équipes": "Conseil personnalisé",
    "Efficacité et rapidité de traitement": "Efficacité/rapidité",
    "Accessibilité et proximité des services": "Accessibilité",
    "Satisfaction sans détails spécifiques": "Satisfaction générique",
    "Expérience digitale et services en ligne pratiques": "Digital",
    "Attente interminable et lenteur en agence": "Attente / Lenteur",
    "Service client injoignable ou non réactif": "Service injoignable",
    "Réclamations ignorées ou mal suivies": "Réclamations ignorées",
    "Incidents techniques et erreurs récurrentes": "Incidents techniques",
    "Frais bancaires jugés abusifs ou non justifiés": "Frais Abusifs",
    "Insatisfaction sans détails spécifiques": "Insatisfaction générique",
    "Manque de considération ou attitude peu professionnelle": "Attitude négative",
    "Autre (positif)": "Autre (+)",
    "Autre (négatif)": "Autre (-)",
    "Hors-sujet ou contenu non pertinent": "Hors-sujet",
}

# Keywords that sort unknown category columns into groups.
POSITIVE_KEYWORDS = ("accueil", "réactif", "conseil", "efficac", "accessib", "satisfaction", "digital")
NEGATIVE_KEYWORDS = ("attente", "injoignable", "réclamation", "incident", "frais", "insatisfaction", "manque")
OTHER_KEYWORDS = ("autre", "hors")

# City name (lower case, no accents) -> region.
CITY_REGIONS = {
    "tanger": "Tanger-Tétouan-Al Hoceïma",
    "tangier": "Tanger-Tétouan-Al Hoceïma",
    "tetouan": "Tanger-Tétouan-Al Hoceïma",
    "al hoceima": "Tanger-Tétouan-Al Hoceïma",
    "oujda": "L'Oriental",
    "nador": "L'Oriental",
    "fes": "Fès-Meknès",
    "fez": "Fès-Meknès",
    "meknes": "Fès-Meknès",
    "rabat": "Rabat-Salé-Kénitra",
    "sale": "Rabat-Salé-Kénitra",
    "kenitra": "Rabat-Salé-Kénitra",
    "temara": "Rabat-Salé-Kénitra",
    "beni mellal": "Béni Mellal-Khénifra",
    "khenifra": "Béni Mellal-Khénifra",
    "casablanca": "Casablanca-Settat",
    "casa": "Casablanca-Settat",
    "settat": "Casablanca-Settat",
    "mohammedia": "Casablanca-Settat",
    "el jadida": "Casablanca-Settat",
    "marrakech": "Marrakech-Safi",
    "marrakesh": "Marrakech-Safi",
    "safi": "Marrakech-Safi",
    "essaouira": "Marrakech-Safi",
    "errachidia": "Drâa-Tafilalet",
    "ouarzazate": "Drâa-Tafilalet",
    "agadir": "Souss-Massa",
    "tiznit": "Souss-Massa",
    "taroudant": "Souss-Massa",
    "guelmim": "Guelmim-Oued Noun",
    "tan-tan": "Guelmim-Oued Noun",
    "laayoune": "Laâyoune-Sakia El Hamra",
    "dakhla": "Dakhla-Oued Ed-Dahab",
}

# Spelling used by the polygon file -> spelling used elsewhere.
REGION_ALIASES = {"Oriental": "L'Oriental"}

# Accepted coordinate box (degrees).
LNG_RANGE = (-17.0, -1.0)
LAT_RANGE = (21.0, 36.0)

# Map centres used when neither a stored lookup nor a gazetteer exists.
DEFAULT_CENTERS = {
    "Rabat": "@34.020882,-6.841650,12z",
    "Casablanca": "@33.589886,-7.603869,12z",
    "Marrakech": "@31.629472,-7.981084,12z",
    "Fes": "@34.033333,-5.000000,12z",
    "Tangier": "@35.759465,-5.833954,12z",
    "Agadir": "@30.427755,-9.598107,12z",
    "Meknes": "@33.893791,-5.547080,12z",
    "Oujda": "@34.680000,-1.910000,12z",
    "Kenitra": "@34.261000,-6.580000,12z",
    "Tetouan": "@35.578780,-5.368470,12z",
    "Safi": "@32.299400,-9.237200,12z",
    "Mohammedia": "@33.686000,-7.383000,12z",
    "Beni Mellal": "@32.337300,-6.359900,12z",
}

# Cities offered when the gazetteer yields none.
DEFAULT_CITIES = (
    "Casablanca", "Rabat", "Marrakech", "Fès", "Tanger", "Agadir",
    "Meknès", "Oujda", "Kénitra", "Tétouan", "Safi", "El Jadida",
)

# Fixed value: shape of a canonical place id.
CANONICAL_PLACE_ID = r"^ChIJ[0-9A-Za-z_-]+$"
