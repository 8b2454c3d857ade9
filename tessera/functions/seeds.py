"""Which DBpedia and Wikidata types are equivalent, and how types are related."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import inverse_name

DBPEDIA, WIKIDATA = "http://dbpedia.org/ontology/", "http://www.wikidata.org/entity/"

# DBpedia type, Wikidata type, confidence.
TYPE_MAPPING = """
Place Q2221906 0.9
City Q515 1.0
Country Q6256 1.0
Capital Q5119 1.0
Settlement Q486972 0.9
Mountain Q8502 1.0
Lake Q23397 1.0
River Q4022 1.0
Road Q34442 0.95
Airport Q1248784 1.0
Region Q82794 0.9
Person Q215627 0.95
Human Q5 1.0
Scientist Q901 1.0
Artist Q483501 0.95
Politician Q82955 0.95
Athlete Q2066131 0.95
Organisation Q43229 1.0
Company Q783794 1.0
GovernmentAgency Q327333 0.95
EducationalInstitution Q2385804 0.95
School Q3914 1.0
University Q3918 1.0
Non-ProfitOrganisation Q163740 0.9
Event Q1656682 0.95
SportsEvent Q1656682 0.9
MusicFestival Q181683 0.95
Election Q40231 0.95
Work Q386724 0.9
CreativeWork Q17537576 0.9
Artwork Q838948 0.95
Book Q571 1.0
Film Q11424 1.0
TelevisionShow Q5398426 0.95
Song Q7366 0.95
MusicalWork Q2188189 0.9
Album Q482994 0.95
WrittenWork Q47461344 0.9
AcademicArticle Q13442814 0.95
VideoGame Q7889 0.95
Software Q7397 0.95
Language Q34770 0.9
Species Q7432 0.9
Disease Q12136 0.95
Vehicle Q42889 0.95
Automobile Q1420 0.95
Computer Q68 0.95
ComputerHardware Q3966 0.9
Electronics Q11650 0.9
Sport Q349 0.95
SportingEvent Q16510064 0.9
Food Q2095 1.0
Beverage Q40050 0.95
FoodIngredient Q25403900 0.95
"""

# Source type, target type (dbo: or wd:), relation, confidence.
TYPE_RELATIONS = """
dbo:Country dbo:City hasCapital 0.9
wd:Q6256 wd:Q5119 hasCapital 0.9
dbo:Country dbo:City hasCity 0.7
wd:Q6256 wd:Q515 hasCity 0.7
dbo:Country dbo:Region hasRegion 0.8
wd:Q6256 wd:Q82794 hasRegion 0.8
dbo:Region dbo:City hasCity 0.8
wd:Q82794 wd:Q515 hasCity 0.8
dbo:Country dbo:Mountain hasMountain 0.7
wd:Q6256 wd:Q8502 hasMountain 0.7
dbo:Country dbo:River hasRiver 0.7
wd:Q6256 wd:Q4022 hasRiver 0.7
dbo:Country dbo:Lake hasLake 0.7
wd:Q6256 wd:Q23397 hasLake 0.7
dbo:Country dbo:Airport hasAirport 0.8
wd:Q6256 wd:Q1248784 hasAirport 0.8
dbo:Organisation dbo:Person foundedBy 0.8
wd:Q43229 wd:Q5 foundedBy 0.8
dbo:Organisation dbo:Person hasMember 0.7
wd:Q43229 wd:Q5 hasMember 0.7
dbo:Company dbo:Person hasCEO 0.8
wd:Q783794 wd:Q5 hasCEO 0.8
dbo:University dbo:Person hasAlumnus 0.8
wd:Q3918 wd:Q5 hasAlumnus 0.8
dbo:University dbo:Person hasProfessor 0.8
wd:Q3918 wd:Q5 hasProfessor 0.8
dbo:Person dbo:Book isAuthorOf 0.9
wd:Q5 wd:Q571 isAuthorOf 0.9
dbo:Person dbo:Film isDirectorOf 0.9
wd:Q5 wd:Q11424 isDirectorOf 0.9
dbo:Person dbo:MusicalWork isComposerOf 0.9
wd:Q5 wd:Q2188189 isComposerOf 0.9
dbo:Person dbo:Sport practicesSport 0.8
wd:Q5 wd:Q349 practicesSport 0.8
dbo:Person dbo:SportsTeam memberOfSportsTeam 0.9
wd:Q5 wd:Q12973014 memberOfSportsTeam 0.9
dbo:SportsTeam dbo:SportingEvent participatesIn 0.8
wd:Q12973014 wd:Q16510064 participatesIn 0.8
dbo:Company dbo:Device manufactures 0.9
wd:Q783794 wd:Q3966 manufactures 0.9
dbo:Company dbo:Software develops 0.9
wd:Q783794 wd:Q7397 develops 0.9
dbo:Software dbo:ComputerHardware runsOn 0.8
wd:Q7397 wd:Q3966 runsOn 0.8
dbo:Food dbo:FoodIngredient hasIngredient 0.9
wd:Q2095 wd:Q25403900 hasIngredient 0.9
dbo:Country dbo:Food hasTraditionalFood 0.8
wd:Q6256 wd:Q2095 hasTraditionalFood 0.8
dbo:Company dbo:Food produces 0.8
wd:Q783794 wd:Q2095 produces 0.8
dbo:Company dbo:Automobile manufactures 0.9
wd:Q783794 wd:Q1420 manufactures 0.9
dbo:Automobile dbo:Company manufacturedBy 0.9
wd:Q1420 wd:Q783794 manufacturedBy 0.9
dbo:Person dbo:Person hasParent 0.9
wd:Q5 wd:Q5 hasParent 0.9
dbo:Person dbo:Person hasChild 0.9
wd:Q5 wd:Q5 hasChild 0.9
dbo:Person dbo:Person hasSibling 0.8
wd:Q5 wd:Q5 hasSibling 0.8
dbo:Person dbo:Person hasSpouse 0.9
wd:Q5 wd:Q5 hasSpouse 0.9
dbo:Disease dbo:Disease hasSymptom 0.8
wd:Q12136 wd:Q169872 hasSymptom 0.8
dbo:Drug dbo:Disease treats 0.8
wd:Q12140 wd:Q12136 treats 0.8
dbo:Disease dbo:Organ affects 0.8
wd:Q12136 wd:Q712378 affects 0.8
dbo:Country dbo:Country sharesBorderWith 0.9
wd:Q6256 wd:Q6256 sharesBorderWith 0.9
dbo:City dbo:River locatedOnRiver 0.8
wd:Q515 wd:Q4022 locatedOnRiver 0.8
dbo:University dbo:AcademicSubject offers 0.8
wd:Q3918 wd:Q11862829 offers 0.8
dbo:Person dbo:AcademicSubject specializedIn 0.7
wd:Q5 wd:Q11862829 specializedIn 0.7
dbo:Artist dbo:Artist influencedBy 0.7
wd:Q483501 wd:Q483501 influencedBy 0.7
dbo:MusicalWork dbo:MusicGenre belongsToGenre 0.8
wd:Q2188189 wd:Q188451 belongsToGenre 0.8
"""


def uri(short: str) -> str:
    return short.replace("dbo:", DBPEDIA).replace("wd:", WIKIDATA)


def type_mapping(spark: SparkSession) -> DataFrame:
    """dbpedia_type, wikidata_type, confidence, ord."""
    rows = [line.split() for line in TYPE_MAPPING.strip().splitlines()]
    return spark.createDataFrame([(DBPEDIA + a, WIKIDATA + b, float(c), i) for i, (a, b, c) in enumerate(rows)], "dbpedia_type string, wikidata_type string, confidence double, ord int")


def type_relations(spark: SparkSession) -> DataFrame:
    """source_type, target_type, relation, confidence, ord, direct: the direct relations, then their inverses at 0.8 of the confidence."""
    rows = [line.split() for line in TYPE_RELATIONS.strip().splitlines()]
    direct = spark.createDataFrame([(uri(a), uri(b), c, float(d), i) for i, (a, b, c, d) in enumerate(rows)], "source_type string, target_type string, relation string, confidence double, ord int").withColumn("direct", F.lit(True))
    inverse = direct.select(F.col("target_type").alias("source_type"), F.col("source_type").alias("target_type"), inverse_name(F.col("relation")).alias("relation"), F.round(F.col("confidence") * 0.8, 2).alias("confidence"), (F.col("ord") + len(rows)).alias("ord"), F.lit(False).alias("direct"))
    return direct.unionByName(inverse)
