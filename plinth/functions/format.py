"""What lines and documents say that they are.

The reader goes by what a line holds and by how its type ends; types are carried as
data from what was read to what is written.
"""

#: How the type of a feature's line ends.
FEATURE_ENDING = "Feature"
#: The types of made-up models.
DOCUMENT, FEATURE = "Model", "ModelFeature"
