"""inkwarp: Spark-native audits of prose corpora, revisions and bibliographic harvests."""
