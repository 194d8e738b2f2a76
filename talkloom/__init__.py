"""talkloom: conversation analytics and corpus preparation on PySpark DataFrames."""
