"""Vocabularies and tables that jobs take as parameters; these are the defaults."""

# Specialties and the words that stand for them.
SPECIALTIES = {
    "icu": ["icu", "intensive care", "critical care", "ccu", "intensive care unit"],
    "dialysis": ["dialysis", "haemodialysis", "hemodialysis", "kidney care"],
    "trauma": ["trauma", "trauma center", "trauma centre", "accident"],
    "cardiology": ["cardiology", "cardiac", "heart", "cath lab"],
    "neurology": ["neurology", "neuro", "neurosurgery", "brain"],
    "oncology": ["oncology", "cancer", "chemotherapy", "chemo"],
    "pediatrics": ["pediatrics", "paediatrics", "pediatric", "paediatric", "child", "neonatal", "nicu"],
    "maternity": ["maternity", "obstetrics", "gynaecology", "gynecology", "obg", "labour"],
    "orthopedics": ["orthopedics", "orthopaedics", "ortho", "bone", "fracture"],
    "nephrology": ["nephrology", "nephrologist", "renal"],
    "general_surgery": ["general surgery", "surgery", "operation theatre", "ot"],
    "emergency": ["emergency", "casualty", "er", "24/7", "24x7", "round the clock"],
}

# Equipment and the words that stand for it.
EQUIPMENT = {
    "oxygen": ["oxygen", "o2", "oxygen cylinder", "oxygen supply"],
    "ventilator": ["ventilator", "vent", "mechanical ventilator", "bipap", "cpap"],
    "mri": ["mri", "magnetic resonance"],
    "ct_scan": ["ct scan", "ct", "cat scan", "computed tomography"],
    "dialysis_machine": ["dialysis machine", "haemodialysis machine", "dialyser"],
    "xray": ["x-ray", "xray", "x ray", "radiography"],
    "ambulance": ["ambulance", "108", "patient transport"],
    "blood_bank": ["blood bank", "blood storage", "transfusion"],
}

# Specialties that count as major.
MAJOR = ["cardiology", "dialysis", "icu", "neurology", "trauma"]

# Words without weight in keyword search.
STOPWORDS = "a an the and or of in on at for to with near nearest by from is are be this that these those it as i we you my".split()

# English stop words of the text encoder.
ENGLISH = (
    "a about above across after afterwards again against all almost alone along already also although always am among amongst amoungst amount an and "
    "another any anyhow anyone anything anyway anywhere are around as at back be became because become becomes becoming been before beforehand behind being "
    "below beside besides between beyond bill both bottom but by call can cannot cant co con could couldnt cry de describe detail do done down due during "
    "each eg eight either eleven else elsewhere empty enough etc even ever every everyone everything everywhere except few fifteen fifty fill find fire "
    "first five for former formerly forty found four from front full further get give go had has hasnt have he hence her here hereafter hereby herein "
    "hereupon hers herself him himself his how however hundred i ie if in inc indeed interest into is it its itself keep last latter latterly least less "
    "ltd made many may me meanwhile might mill mine more moreover most mostly move much must my myself name namely neither never nevertheless next nine no "
    "nobody none noone nor not nothing now nowhere of off often on once one only onto or other others otherwise our ours ourselves out over own part per "
    "perhaps please put rather re same see seem seemed seeming seems serious several she should show side since sincere six sixty so some somehow someone "
    "something sometime sometimes somewhere still such system take ten than that the their them themselves then thence there thereafter thereby therefore "
    "therein thereupon these they thick thin third this those though three through throughout thru thus to together too top toward towards twelve twenty "
    "two un under until up upon us very via was we well were what whatever when whence whenever where whereafter whereas whereby wherein whereupon wherever "
    "whether which while whither who whoever whole whom whose why will with within without would yet you your yours yourself yourselves "
).split()

# State and territory names.
STATES = [
    "andhra pradesh", "arunachal pradesh", "assam", "bihar", "chhattisgarh", "goa", "gujarat", "haryana", "himachal pradesh", "jharkhand", "karnataka", "kerala", "madhya pradesh",
    "maharashtra", "manipur", "meghalaya", "mizoram", "nagaland", "odisha", "punjab", "rajasthan", "sikkim", "tamil nadu", "telangana", "tripura", "uttar pradesh", "uttarakhand",
    "west bengal", "andaman and nicobar islands", "chandigarh", "dadra and nagar haveli and daman and diu", "delhi", "jammu and kashmir", "ladakh", "lakshadweep", "puducherry",
]

# Short forms of state names.
STATE_ALIASES = {
    "ap": "andhra pradesh", "ar": "arunachal pradesh", "as": "assam", "br": "bihar", "ct": "chhattisgarh", "cg": "chhattisgarh", "ga": "goa", "gj": "gujarat", "hr": "haryana",
    "hp": "himachal pradesh", "jh": "jharkhand", "jk": "jammu and kashmir", "j&k": "jammu and kashmir", "ka": "karnataka", "kl": "kerala", "mp": "madhya pradesh", "mh": "maharashtra",
    "mn": "manipur", "ml": "meghalaya", "mz": "mizoram", "nl": "nagaland", "od": "odisha", "or": "odisha", "pb": "punjab", "rj": "rajasthan", "sk": "sikkim", "tn": "tamil nadu",
    "tg": "telangana", "ts": "telangana", "tr": "tripura", "up": "uttar pradesh", "uk": "uttarakhand", "ut": "uttarakhand", "wb": "west bengal", "dl": "delhi", "ch": "chandigarh",
    "py": "puducherry", "pondicherry": "puducherry", "an": "andaman and nicobar islands", "andaman": "andaman and nicobar islands", "ld": "lakshadweep", "la": "ladakh",
    "dn": "dadra and nagar haveli and daman and diu",
}

# Names under which a source may hold each canonical column; the first found wins.
COLUMN_ALIASES = {
    "hospital_name": ["hospital_name", "hospital name", "name", "hospital", "hosp_name", "facility", "facility_name", "facility name", "institution"],
    "state": ["state", "state_name", "state name", "address_stateorregion", "address_state", "stateorregion"],
    "district": ["district", "district_name", "district name", "city", "address_city"],
    "pin_code": ["pin_code", "pincode", "pin code", "pin", "zip", "postal_code", "postal code", "address_ziporpostcode", "ziporpostcode", "address_postcode"],
    "address": ["address", "addr", "location_address", "full_address", "address_line1"],
    "specialties": ["specialties", "specialty", "speciality", "specialities", "services", "departments", "department"],
    "equipment": ["equipment", "equipments", "facilities", "infrastructure", "amenities", "resources"],
    "procedure": ["procedure", "procedures"],
    "capability": ["capability", "capabilities"],
    "notes": ["notes", "description", "remarks", "about", "details", "comments"],
    "staff": ["staff", "staffing", "staff_count", "staff count", "doctors", "nurses", "personnel", "manpower", "numberdoctors", "number_doctors", "doctor_count", "physicians"],
    "facility_type": ["facility_type", "facilitytypeid", "facility_type_id", "type"],
    "phone": ["phone", "contact", "phone_number", "phone number", "mobile", "officialphone", "official_phone", "phone_numbers"],
    "latitude": ["latitude", "lat"],
    "longitude": ["longitude", "lon", "lng", "long"],
}
LISTS = ["specialties", "equipment", "procedure", "capability", "staff", "phone"]

# Words that speak of staff, for scores and for citations; equipment words of last resort.
STAFF_WORDS = ["doctor", "nurse", "staff", "physician", "specialist", "consultant"]
STAFF_CITED = [*STAFF_WORDS, "anesthesiologist"]
EQUIPMENT_HINTS = ["mri", "ct ", "x-ray", "xray", "ventilator", "oxygen", "dialysis", "scan", "lab"]
BLANKS = ["", "[]", "null", "None", "nan"]
EARTH_KM = 6371.0088
