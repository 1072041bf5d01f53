-- One raw lead per order. The same text runs in Spark SQL and in DuckDB.
WITH b AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS d,
         CAST(1000 + CASE WHEN o_orderkey % 20 = 19 THEN o_orderkey - 1 WHEN o_orderkey % 60 = 17 THEN o_orderkey + 1 ELSE o_orderkey END AS STRING) AS n,
         CAST(year(o_orderdate) AS STRING) AS yy, CAST(month(o_orderdate) AS STRING) AS mm, CAST(day(o_orderdate) AS STRING) AS dd,
         CAST(2 + o_custkey % 90 AS STRING) AS e1, CAST(12 + o_custkey % 90 AS STRING) AS e2,
         CAST(1 + o_custkey % 18 AS STRING) AS b1, CAST(3 + o_custkey % 18 AS STRING) AS b2
  FROM orders),
r AS (
  SELECT k + 2 AS source_row,
    CASE WHEN k % 97 = 0 THEN 'header' WHEN k % 101 = 0 THEN 'TESTROW' WHEN k % 103 = 0 THEN 'asdf' WHEN k % 59 = 0 THEN '' WHEN k % 61 = 0 THEN 'L-7'
         WHEN k % 20 = 19 AND k % 40 = 39 THEN 'L-' || n || '-dup' WHEN k % 6 = 0 THEN n ELSE ' L-' || n END AS lead_id,
    CASE k % 7 WHEN 0 THEN lpad(mm,2,'0') || '/' || lpad(dd,2,'0') || '/' || yy
               WHEN 1 THEN yy || '-' || lpad(mm,2,'0') || '-' || lpad(dd,2,'0')
               WHEN 2 THEN lpad(dd,2,'0') || '-' || lpad(mm,2,'0') || '-' || yy
               WHEN 3 THEN mm || '/' || dd || '/' || substring(yy,3,2)
               WHEN 4 THEN substring('JanFebMarAprMayJunJulAugSepOctNovDec', 3*month(d)-2, 3) || ' ' || dd || ' ' || yy
               WHEN 5 THEN 'asdf' ELSE '' END AS created,
    CASE WHEN k % 41 = 0 OR k % 29 = 0 THEN ' N/A ' ELSE '  Contact   ' || CAST(c AS STRING) || ' ' END AS name,
    CASE WHEN k % 41 = 0 THEN '' WHEN k % 11 = 0 THEN 'user' || CAST(c AS STRING) || '[at]Firm.IO'
         WHEN k % 11 = 1 THEN 'user' || CAST(c AS STRING) || ' ( AT ) firm.agency' WHEN k % 11 = 2 THEN 'ivan@'
         WHEN k % 11 = 3 THEN 'weird-email-no-domain' WHEN k % 11 = 4 THEN 'deji m.@scaleforge' WHEN k % 11 = 5 THEN ''
         ELSE 'User' || CAST(c AS STRING) || '@Firm' || CAST(c % 9 AS STRING) || '.co' END AS email,
    CASE WHEN k % 41 = 0 OR k % 31 = 0 THEN '-' ELSE 'Firm ' || CAST(c AS STRING) END AS company,
    CASE k % 13 WHEN 0 THEN e1 || '-' || e2 WHEN 1 THEN '~' || e1 WHEN 2 THEN e1 || '+' WHEN 3 THEN '' WHEN 4 THEN 'asdf'
                WHEN 5 THEN 'about ' || e1 || ' people' WHEN 6 THEN '1' WHEN 7 THEN '1,200' ELSE e1 END AS employees,
    CASE k % 5 WHEN 0 THEN 'https://www.Firm' || CAST(c AS STRING) || '.io/' WHEN 1 THEN 'http://firm' || CAST(c AS STRING) || '.agency'
               WHEN 2 THEN 'www.firm' || CAST(c AS STRING) || '.ng' WHEN 3 THEN '' ELSE 'firm' || CAST(c AS STRING) || '.africa' END AS website,
    CASE k % 19 WHEN 0 THEN 'CEO' WHEN 1 THEN 'Founder' WHEN 2 THEN 'Owner' WHEN 3 THEN 'Managing Director' WHEN 4 THEN 'VP Growth'
                WHEN 5 THEN 'Head   of   Ops' WHEN 6 THEN 'Director of Ops' WHEN 7 THEN 'Student' WHEN 8 THEN 'Freelancer'
                WHEN 9 THEN 'Developer' WHEN 10 THEN '' WHEN 11 THEN 'Consultant' WHEN 12 THEN 'COO' WHEN 13 THEN 'CTO'
                WHEN 14 THEN 'Managing Partner' WHEN 15 THEN 'President' WHEN 16 THEN 'Recruiter' WHEN 17 THEN 'Marketing Manager' ELSE 'Head of RevOps' END AS title,
    CASE k % 6 WHEN 0 THEN 'Webform' WHEN 1 THEN 'linkedin' WHEN 2 THEN ' Referral ' WHEN 3 THEN 'cold  reply' WHEN 4 THEN 'event' ELSE '' END AS source,
    CASE k % 17 WHEN 0 THEN '$' || b1 || 'k/mo' WHEN 1 THEN b1 || ',500/mo' WHEN 2 THEN '$' || b1 || '-' || b2 || 'k' WHEN 3 THEN b1 || 'k-' || b2 || 'k'
                WHEN 4 THEN 'TBD' WHEN 5 THEN 'depends' WHEN 6 THEN '' WHEN 7 THEN '0' WHEN 8 THEN '500' WHEN 9 THEN '$8,500'
                WHEN 10 THEN b1 || 'K per month' WHEN 11 THEN '~5k' WHEN 12 THEN b1 || '.5k' WHEN 13 THEN '?' ELSE b1 || '000' END AS monthly_budget,
    CASE k % 37
      WHEN 0 THEN 'I am a developer looking for a role. Attaching my CV.' WHEN 1 THEN 'VC here, not a direct buyer.'
      WHEN 2 THEN 'hi! CS student, university project' WHEN 3 THEN 'Journalist, looking for a quote.'
      WHEN 4 THEN 'Fellow agency owner here, mostly researching the market.' WHEN 5 THEN 'We have automation devs on our bench.'
      WHEN 6 THEN 'Offering offshore dev team at $5/hr, interested?' WHEN 7 THEN 'You have WON $1,000,000!!! Click here to claim.'
      WHEN 8 THEN 'This is a newsletter signup that ended up here by mistake.' WHEN 9 THEN 'ignore this'
      WHEN 10 THEN '' WHEN 11 THEN 'Reached out on a Tuesday afternoon.' WHEN 12 THEN 'QA test entry, please ignore.'
      ELSE CASE k % 4 WHEN 0 THEN 'We are a SEO agency,  40 people. ' WHEN 1 THEN 'Small business, not an agency. ' WHEN 2 THEN 'SaaS company here. ' ELSE 'Local shop. ' END
        || CASE k % 23 WHEN 0 THEN 'Budget approved. ' WHEN 1 THEN 'Budgeted, serious. ' WHEN 2 THEN 'Wants to start ASAP. ' WHEN 3 THEN 'I make the call here. '
             WHEN 4 THEN 'It is eating our week. ' WHEN 5 THEN 'Real budget. ' WHEN 6 THEN 'Money to spend. ' WHEN 7 THEN 'We have some budget. ' WHEN 8 THEN 'Comparing a few options. '
             WHEN 9 THEN 'Interested but vague on scope. ' WHEN 10 THEN 'Price sensitive. ' WHEN 11 THEN 'Budget not locked yet. ' WHEN 12 THEN 'Would need to loop in the team. '
             WHEN 13 THEN 'Not sure who signs off internally. ' WHEN 14 THEN 'wont share budget yet. ' WHEN 15 THEN 'No real budget yet. ' WHEN 16 THEN 'One-man shop. '
             WHEN 17 THEN 'Budget way below range. ' WHEN 18 THEN 'cant really pay right now. ' WHEN 19 THEN 'Budget approved. Budgeted, serious. Keen to move fast. ' ELSE '' END
        || CASE k % 9 WHEN 0 THEN 'Budget approved, wants to start ASAP.' WHEN 1 THEN 'Decision is mine.' WHEN 2 THEN 'This is my priority to solve.'
             WHEN 3 THEN 'Want it automated end to end.' WHEN 4 THEN 'Budgeted, serious.' ELSE '' END
    END AS notes0, k, k % 107 = 0 AS blank
  FROM b)
SELECT source_row,
  CASE WHEN blank THEN '' ELSE lead_id END AS lead_id, CASE WHEN blank THEN '' ELSE created END AS created,
  CASE WHEN blank THEN '' WHEN k % 103 = 0 THEN 'asdf' ELSE name END AS name, CASE WHEN blank THEN '' ELSE email END AS email,
  CASE WHEN blank THEN '  ' WHEN k % 103 = 0 THEN 'asdf' ELSE company END AS company, CASE WHEN blank THEN '' ELSE employees END AS employees,
  CASE WHEN blank THEN '' ELSE website END AS website, CASE WHEN blank THEN '' WHEN k % 103 = 0 THEN 'asdf' ELSE title END AS title,
  CASE WHEN blank THEN '' WHEN k % 103 = 0 THEN 'asdf' ELSE source END AS source, CASE WHEN blank THEN '' ELSE monthly_budget END AS monthly_budget,
  CASE WHEN blank THEN '' WHEN k % 40 = 19 THEN '(duplicate submission) ' || notes0 ELSE notes0 END AS notes
FROM r
