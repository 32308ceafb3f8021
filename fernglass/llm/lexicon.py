"""Word lists that several operators share. All are fixed values of general knowledge."""

from __future__ import annotations

#: Given names.
GIVEN_NAMES = frozenset(
    """alexander alice amina andrew anna anneke anthony anton arthur barbara benjamin bram brian carlos carmen caroline charles charlotte christine
    christopher clara daniel david deborah dennis dieter dorothy edward elizabeth ellen emily emma eric esther eva felix francis frank frederick
    george gerald greta gustav hannah hans harold harriet hedda helen henry hugo ingrid irene iris jack jacob james jane jan janet jean jennifer
    john joseph josephine juan julia karen karl katherine kenji kenneth laura lars lena leonard linda louis lucien lucy luis margaret maria marie
    marisol mark martha martin mary mateo matthew michael nancy nathaniel nicholas nina noor odile oliver olivia pablo patricia patrick paul peter
    philip philippa pierre priya rachel raymond rebecca richard robert roger ronald rosalind ruth samuel sandra sarah selma simon sofia sophie
    stephen susan theodore theresa thomas timothy tobias victor victoria vincent walter wendy william yusuf yvonne""".split()
)
#: Well-known short forms of given names, beside those of the table of nicknames.
SHORT_FORMS = {
    "alex": "alexander", "al": "alexander", "andy": "andrew", "ben": "benjamin", "barb": "barbara", "beth": "elizabeth", "betty": "elizabeth", "bert": "albert", "bill": "william",
    "bob": "robert", "charlie": "charles", "chris": "christine", "chuck": "charles", "dan": "daniel", "dave": "david", "debbie": "deborah", "dick": "richard",
    "dot": "dorothy", "ed": "edward", "eddie": "edward", "ellie": "ellen", "frank": "francis", "fred": "frederick", "freddie": "frederick", "gerry": "gerald", "gus": "gustav",
    "hal": "harold", "harry": "harold", "hank": "henry", "jack": "john", "jenny": "jennifer", "jim": "james", "joe": "joseph", "kate": "katherine",
    "ken": "kenneth", "larry": "lawrence", "lexi": "alexander", "maggie": "margaret", "meg": "margaret", "matt": "matthew", "nat": "nathaniel", "nick": "nicholas", "ollie": "oliver",
    "pam": "pamela", "peg": "margaret", "phil": "philip", "pip": "philippa", "rose": "rosalind", "ros": "rosalind", "sally": "sarah", "sandy": "alexander", "mick": "michael", "mickey": "michael", "nell": "helen", "molly": "mary", "polly": "mary", "mandy": "amanda", "trudy": "gertrude", "lottie": "charlotte", "hattie": "harriet", "nan": "anna", "dolly": "dorothy", "dottie": "dorothy", "steve": "stephen", "sue": "susan", "ted": "theodore",
    "terry": "theresa", "tess": "theresa", "tim": "timothy", "tina": "christine", "toby": "tobias", "vince": "vincent", "vic": "victoria", "walt": "walter",
}
#: Titles before a name.
TITLES = frozenset("mr mrs ms miss mx dr prof sir dame madam herr frau fräulein dhr mevr mevrouw mijnheer mme mlle m señor señora sr sra don doña".split())
#: Legal forms and what stands with them in a firm's name.
LEGAL_FORMS = frozenset("inc incorporated llc llp ltd limited plc co company corp corporation gmbh ag kg ohg ug bv nv vof sa sas sarl srl sl spa ab as oy sons son the and und et y en".split())
#: Words for a line of trade, and adjectives that stand before them.
TRADE_WORDS = (
    """agency antiques appliances associates auto bakery bank bar bistro bookshop boutique brewery brothers butcher cafe camera catering centre
    chemist cinema cleaners clinic clothing coffee computers construction dairy deli dental department design dentist diner electric electronics
    engineering express fashion fitness florist foods fuel furniture galleries garage garden gift grand grill grocery gym hardware hotel house insurance
    international jewellers kitchen laundry legal library logistics lounge market media motors music nursery optician outlet parking pharmacy
    photography pizzeria plumbing post printing repairs restaurant salon school security services shoes shop solutions sports stationery store
    studio supermarket supplies taxi telecom theatre tools toys trading transport travel university veterinary wines""".split()
)
