"""Decision-shaped texts and index pages made from the test tables; the same SQL runs in Spark and DuckDB."""

DECISIONS = """
select doc_id,
  'Republic of the Philippines' || chr(10) || 'Supreme Court' || chr(10) || 'Manila' || chr(10) || chr(10) ||
  case when doc_id % 5 = 0 then 'FIRST DIVISION' when doc_id % 5 = 1 then 'SECOND DIVISION'
       when doc_id % 5 = 2 then 'THIRD DIVISION' when doc_id % 5 = 3 then 'EN BANC' else 'Special Session' end ||
  chr(10) || chr(10) || '[ ' || case when doc_id % 7 = 0 then 'A.M. No. ' else 'G.R. No. ' end ||
  cast(100000 + doc_id % 97 as varchar(20)) || ' ]' || chr(10) || chr(10) ||
  'D E C I S I O N' || chr(10) || chr(10) || substr(text,1,300) || chr(10) || chr(10) ||
  'The Facts:' || chr(10) || chr(10) || text || chr(10) || chr(10) ||
  'ISSUES' || chr(10) || 'RULING' || chr(10) || chr(10) || substr(text,1,500) || chr(10) || chr(10) ||
  'WHEREFORE' || chr(10) || chr(10) || substr(text,1,200) || chr(10) || chr(10) ||
  'SO ORDERED' || chr(10) || chr(10) || substr(text,201,100) as text
from documents
"""

INDEX_PAGES = """
select page_id, '<html><body><div id="content"><h3>' || cast(1990 + page_id % 12 as varchar(20)) || '</h3><a href="/docmonth/Jan/' ||
cast(1990 + page_id % 12 as varchar(20)) || '/1">Jan</a><a href="/m?x=2">Feb</a><strong>' ||
cast(2000 + page_id % 9 as varchar(20)) || '</strong><a href="/m?x=3">Mar</a><a href="/m?x=4">Mar</a><a href="/about">About</a></div></body></html>' as html
from pages
"""

MONTH_PAGES = """
select page_id, '<html><body><div id="content"><a href="/d/1/' || cast(page_id as varchar(20)) || '">G.R. No. ' || cast(100000 + page_id as varchar(20)) ||
'</a><a href="/printer/' || cast(page_id as varchar(20)) || '">G.R. No. 7</a><a href="/x/' || cast(page_id as varchar(20)) ||
'">AM-05-1</a><a href="/x/' || cast(page_id as varchar(20)) || '">AM-05-1</a><a href="/jan">Jan</a><a href="/e"></a><a href="/n">Nos. 12</a></div></body></html>' as html
from pages
"""
