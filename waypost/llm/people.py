"""Given names, their short forms, credentials and titles (fixed values)."""

from __future__ import annotations

# Given names, each with the short forms in use.
GIVEN_FORMS = {
    "abigail": "abby abbie gail", "albert": "al bert", "alexander": "alex", "alice": "", "andrew": "andy drew", "angela": "angie", "anna": "ann anne annie",
    "anthony": "tony", "arthur": "art artie", "barbara": "barb babs barbie", "benjamin": "ben benny benji", "brian": "", "carlos": "", "carol": "",
    "catherine": "cathy cath", "charles": "charlie chuck chas charley", "christina": "tina chris chrissy christy", "christopher": "topher kit", "cynthia": "cindy",
    "daniel": "dan danny", "david": "dave davey", "deborah": "deb debbie debby debra", "dennis": "denny", "diana": "diane di", "donald": "don donny donnie",
    "dorothy": "dot dottie", "edward": "ed eddie ned", "eleanor": "ellie nora", "elizabeth": "liz beth betty eliza lizzie betsy libby lisa", "emily": "emmy",
    "eric": "", "eugene": "gene", "evelyn": "evie", "francis": "", "franklin": "frank frankie", "frederick": "fred freddy freddie", "george": "", "gerald": "gerry jerry",
    "gregory": "greg gregg", "harold": "harry hal", "helen": "", "henry": "hank", "ignacio": "nacho iggy", "isabel": "izzy", "jacob": "jake", "james": "jim jimmy jamie jimmie",
    "jason": "", "jennifer": "jen jenny jenn jennie", "jessica": "jess jessie", "john": "johnny jack", "jonathan": "jon", "joseph": "joe joey", "joshua": "josh", "juan": "",
    "julia": "julie", "karen": "", "katherine": "kate kathy katie kay kat kathryn", "kenneth": "ken kenny", "kevin": "kev", "kimberly": "kim", "laura": "laurie",
    "lawrence": "larry lars", "leonard": "len leo lenny lennie", "linda": "lindy", "louis": "lou louie", "margaret": "peggy maggie meg marge margie peg", "maria": "", "mark": "",
    "martha": "marty", "mary": "molly", "matthew": "matt", "melissa": "missy", "michael": "mike mick mickey micky mikey", "michelle": "shelly", "nancy": "nan", "natalie": "",
    "nathaniel": "nate nathan nat natty", "nicholas": "nick nicky", "olivia": "liv livvy livia ollie", "ophelia": "phelia lia", "oscar": "", "pamela": "pam pammy", "patricia": "pat patty trish",
    "patrick": "paddy", "paul": "", "peter": "pete", "philip": "phil", "quentin": "quint quin quinn", "rachel": "", "raymond": "ray", "rebecca": "becky becca reba", "richard": "rick dick rich richie ricky",
    "robert": "bob rob bobby robbie bert", "roger": "", "ronald": "ron ronnie", "ruth": "", "samuel": "sam sammy", "sandra": "sandy", "sarah": "sara sally", "sharon": "",
    "stephen": "steve steven", "susan": "sue susie suzy suzie", "teresa": "terry tess", "theodore": "ted teddy theo", "thomas": "tom tommy", "timothy": "tim timmy",
    "ulysses": "uly lee", "victor": "vic", "victoria": "vicky tori vicki vickie", "vincent": "vince vinny vinnie vin", "walter": "walt wally", "wendy": "", "william": "bill will billy willie willy liam",
    "winifred": "winnie win freda", "yolanda": "yoli yola yolie", "zachary": "zach zack zac",
    "aaron": "", "adam": "", "amanda": "mandy", "amy": "", "ana": "", "bernard": "bernie", "brandon": "", "carmen": "", "gary": "", "gloria": "", "heather": "", "jane": "", "janet": "", "jeffrey": "jeff",
    "joan": "", "jose": "pepe", "judith": "judy", "justin": "", "keith": "", "luis": "", "marie": "", "megan": "", "miguel": "", "pedro": "", "ralph": "", "rita": "", "rosa": "", "russell": "russ", "scott": "", "stanley": "stan",
    "stephanie": "steph", "tyler": "", "virginia": "ginny",
}
GIVEN = {f: full for full, forms in GIVEN_FORMS.items() for f in (*forms.split(), full)}
CREDENTIALS = {"md", "do", "dds", "dmd", "np", "pa", "dc", "rn", "phd", "dpm", "od", "lcsw", "fnp", "crnp", "esq", "jr", "sr"}
TITLES = {"dr", "doctor", "mr", "mrs", "ms", "miss", "prof", "atty"}
