"""Words that surrogates are drawn from; none is a word list of anybody's data."""

from __future__ import annotations

MALE = tuple(
    """adrian albert anton arthur barry benedict bernard brendan cameron clement conrad damien darren declan dominic duncan edgar edmund ernest
    felix fergus francis gareth gilbert gordon graham gregory harold hector hugo ivan jasper jerome julian keith kenneth lachlan laurence leonard
    lionel malcolm marcus maurice mervyn neville nigel norman oscar patrick philip quentin ralph raymond reuben roderick roland rupert sebastian
    stanley stuart terence tobias trevor vernon vincent walter warwick wilfred""".split()
)
FEMALE = tuple(
    """adele agnes alison amanda anita annette audrey beatrice bernadette bridget brenda camilla carmel cecilia celeste clara corinne daphne
    deborah delia dorothy edith eileen elaine eleanor elspeth eunice felicity fiona frances gemma geraldine gillian gwendolyn harriet helena
    imogen ingrid isobel jacinta janice jocelyn judith leonie lorraine louisa mabel marguerite marianne marjorie maureen miriam muriel nadine
    noreen olga pamela phoebe priscilla rosalind roslyn rowena sabrina sylvia tabitha therese ursula valerie veronica winifred yvonne""".split()
)
SURNAMES = tuple(
    """Abernathy Aldridge Ashdown Atherton Bainbridge Balfour Bancroft Barlow Beckett Bellamy Birtwistle Blackwood Bramwell Brockway Burgess
    Calloway Carmody Cavanagh Chadwick Clifford Colquhoun Corrigan Cranston Dalgleish Danvers Delaney Dempster Dinsdale Donnelly Drummond
    Eastwood Ellery Fairbairn Farquhar Fenwick Fitzgerald Forsyth Gallagher Garfield Gillespie Goodwin Gresham Hadley Halloran Hargreaves
    Hathaway Hawthorne Hennessy Holloway Hollingworth Ingleby Jefferies Kavanagh Kendrick Kirkwood Langford Lockhart Lonsdale Loxton MacAlister
    Mansfield Marchbanks Maxwell McPherson Meredith Merriman Montague Mulholland Newbury Northcott Oakley Osborne Pemberton Pendleton Prendergast
    Quigley Radcliffe Rafferty Ravenscroft Redmond Rothwell Rutherford Sanderson Sheridan Sinclair Southgate Stafford Stanhope Sutherland
    Tattersall Templeton Thackeray Thorburn Tolliver Trevelyan Underwood Vickers Wainwright Walcott Wetherill Whitlock Winterbourne Woodhouse
    Yardley Youngblood""".split()
)
STREETS = tuple("Alder Aspen Boronia Cassia Cedar Cypress Elm Fern Grevillea Hakea Heath Ironbark Juniper Kurrajong Laurel Linden Mulga Myrtle Olive Peppermint Poplar Quandong Rowan Saltbush Sedge Sorrel Tallow Teatree Thyme Wattle Willow Yarrow".split())
ORGANISATIONS = tuple("Ashvale Brightwater Copperfield Driftwood Eastmere Fernhill Goldcrest Highmoor Irongate Kestrel Lakeview Meadowbank Nettleton Oakhaven Pinecrest Quarrybrook Ridgeline Silverton Thornbury Upland Valewood Westmere Yarrowdale".split())
#: Places by state with their postcodes; real ones, so that a surrogate reads like an address.
PLACES = {
    "NSW": (("Bathurst", "2795"), ("Goulburn", "2580"), ("Armidale", "2350"), ("Griffith", "2680"), ("Lismore", "2480"), ("Kempsey", "2440"), ("Parkes", "2870"), ("Cowra", "2794"), ("Young", "2594"), ("Mudgee", "2850")),
    "VIC": (("Echuca", "3564"), ("Sale", "3850"), ("Horsham", "3400"), ("Warragul", "3820"), ("Wangaratta", "3677"), ("Colac", "3250"), ("Benalla", "3672"), ("Hamilton", "3300")),
    "QLD": (("Roma", "4455"), ("Gympie", "4570"), ("Dalby", "4405"), ("Kingaroy", "4610"), ("Emerald", "4720"), ("Warwick", "4370"), ("Ayr", "4807")),
    "SA": (("Berri", "5343"), ("Loxton", "5333"), ("Clare", "5453"), ("Naracoorte", "5271"), ("Kadina", "5554")),
    "WA": (("Narrogin", "6312"), ("Katanning", "6317"), ("Merredin", "6415"), ("Moora", "6510"), ("Northam", "6401")),
    "TAS": (("Ulverstone", "7315"), ("Smithton", "7330"), ("Scottsdale", "7260"), ("Wynyard", "7325")),
    "NT": (("Katherine", "0850"), ("Tennant Creek", "0860"), ("Nhulunbuy", "0880")),
    "ACT": (("Belconnen", "2617"), ("Gungahlin", "2912"), ("Weston", "2611")),
}
