DELETE FROM pallets WHERE mass < 1;
SELECT q.code, count(*) FROM quay q JOIN pallets p ON p.bound = q.code GROUP BY q.code;
